"""Blocks of vectors meet without a row written for a visit."""

import numpy as np

from featherloom.llm import cells


def test_a_vector_is_written_once_however_many_cells_it_visits(spark, monkeypatch):
    """Before, each vector was written for its home and once more for each of the cells that it visits, here all."""
    rows, write = {}, cells.written

    def counted(df, name):
        out = write(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(cells, "written", counted)
    monkeypatch.setattr(cells, "CELL", 50)
    monkeypatch.setattr(cells, "BLOCK_BYTES", 8 * 8 * 30)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 8))
    x[300:] = x[:100] + 0.02 * rng.standard_normal((100, 8))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(axis=1) - 1
    got = cells.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>"), threshold=0.95).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate(links.tolist())) and links.sum() >= 200
    assert rows["cells-placed"] == 400 and rows["cells-blocks"] >= 400 / 30


def test_blocks_of_one_cell_and_of_cells_with_one_vector(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_BYTES", 16)
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [1.0, 0.0]), (5, [1.0, 0.0, 0.0]), (6, [1.0, 0.001, 0.0])]
    rows += [(10 + i, [-1.0, 0.001 * i]) for i in range(40)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cells.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 5, 6)] == [(2, 1), (2, 1), (0, 3), (2, 1), (1, 5), (1, 5)]
    assert all(got[10 + i] == (39, 10) for i in range(40))
