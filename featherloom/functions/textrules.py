"""Text cleaning as data: ordered (pattern, replacement) lists applied by one small engine.

Patterns are Java regular expressions and stay inside Spark's code generation.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, functions as F

Rules = Sequence[tuple[str, str]]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expression to a lambda variable, so that inner lambdas do not evaluate it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def apply_rules(text: Column | str, rules: Rules) -> Column:
    out = _col(text)
    for pattern, replacement in rules:
        out = F.regexp_replace(out, pattern, replacement)
    return out


# -- fixed values: the rule lists, in the order in which they apply ----------------------------

COMMENT_BEFORE_LOWER: Rules = (
    (r"[^A-Za-z0-9,*!?./']", " "),
    (r"\d+", " "),
)

CONTRACTIONS: Rules = (
    ("what's", "what is "),
    ("'s", " "),
    ("'ve", " have "),
    ("can't", "cannot "),
    ("n't", " not "),
    ("i'm", "i am "),
    ("'re", " are "),
    ("'d", " would "),
    ("'ll", " will "),
)

COMMENT_AFTER_LOWER: Rules = (
    *CONTRACTIONS,
    (",", " "),
    (r"\.", " "),
    ("!", " ! "),
    (r"\?", " ? "),
    ("/", " "),
    ("'", " "),
    (" e g ", " eg "),
    (" b g ", " bg "),
    (" u s ", " american "),
)

# the allowed set contains the character range from '+' to '='
QUESTION_RULES: Rules = (
    (r"[^A-Za-z0-9^,!./'+-=]", " "),
    *CONTRACTIONS,
    (",", " "),
    (r"\.", " "),
    ("!", " ! "),
    ("/", " "),
    (r"\^", " ^ "),
    (r"\+", " + "),
    ("-", " - "),
    ("=", " = "),
    ("'", " "),
    (r"(\d+)k", "$1000"),
    (":", " : "),
    (" e g ", " eg "),
    (" b g ", " bg "),
    (" u s ", " american "),
    (r"\x00s", "0"),
    (" 9 11 ", "911"),
    ("e - mail", "email"),
    ("j k", "jk"),
    (r"\s{2,}", " "),
)

CHAR_GRAM_CONTRACTIONS: Rules = (
    (r"(W|w)on't", "will not"),
    (r"(C|c)an't", "can not"),
    (r"(I|i)'m", "i am"),
    (r"(A|a)in't", "is not"),
    (r"(\w+)'ll", "$1 will"),
    (r"(\w+)n't", "$1 not"),
    (r"(\w+)'ve", "$1 have"),
    (r"(\w+)'s", "$1 is"),
    (r"(\w+)'re", "$1 are"),
    (r"(\w+)'d", "$1 would"),
)

CHAR_GRAM_TAIL: Rules = (
    (r"[!-/:-@\[-`{-~]", ""),
    (r"\d+", " "),
    (r"\s+", " "),
    (r"\s+$", ""),
)

FULL_WIDTH = "，、（）。；：“”－"
HALF_WIDTH = ",,().;:\"\"-"
TERM_FIXES = (("Ca", "癌"), ("子宫颈", "宫颈"))
SIGN_WORDS = (("(-)", "阴性"), ("(+)", "阳性"))
MARKER = "复查"

RECORD_FULL_WIDTH = "，。；：？“”、／（）"
RECORD_HALF_WIDTH = ",.;:?\"\",/()"
RECORD_RULES: Rules = (
    (r"[\t\n]", ""),
    ("病例特点|次/次分|次/分|℃", ""),
    ("&quot|&;|[-%/*^ ．°C]", ""),
    (r"\(.*?\)", ""),
    (r"[0-9.]+[A-Za-z]+", ""),
    (r"[0-9.]+", ""),
    ("[一二三四五]+,", ""),
    (r"[.,:;\"?]+", ","),
)
PERSON_RULES: Rules = (
    (",(.*?)姓名(.*?),", ""),
    (",(.*?)性别(.*?),", ""),
    (",(.*?)年龄(.*?),", ""),
)

# -- cleaning steps ----------------------------------------------------------------------------


def clean_comment(text: Column | str, before: Rules = COMMENT_BEFORE_LOWER, after: Rules = COMMENT_AFTER_LOWER) -> Column:
    """Allowed characters only, digits to blanks, lower case, contractions, spaced punctuation.

    Other variants of the cleaning are other rule lists ``before`` and ``after`` lower-casing.
    """
    return apply_rules(F.lower(apply_rules(text, before)), after)


def clean_question(text: Column | str, stop_words: Sequence[str] = ()) -> Column:
    """The long rule list over lower-cased, blank-normalised text; stop words are optional."""
    words = tokens(F.lower(_col(text)))
    if stop_words:
        words = without_words(words, stop_words)
    return apply_rules(F.array_join(words, " "), QUESTION_RULES)


def tokens(text: Column | str) -> Column:
    """Non-empty blank-separated tokens."""
    return F.regexp_extract_all(_col(text), F.lit(r"\S+"), F.lit(0))


def without_words(words: Column, stop_words: Sequence[str]) -> Column:
    """Drop listed words, keeping order and repeats."""
    return F.filter(words, lambda w: ~w.isin(*stop_words))


def remove_stop_words(text: Column | str, stop_words: Sequence[str]) -> Column:
    return F.array_join(without_words(tokens(text), stop_words), " ")


def squeeze_letters(text: Column | str) -> Column:
    """Runs of the same lower-case letter become two letters."""
    return F.regexp_replace(_col(text), r"([a-z])\1+", "$1$1")


def map_tokens(text: Column | str, table: Mapping[str, str]) -> Column:
    """Replace whole tokens by a small literal map (for a large one use ``map_tokens_by_join``)."""
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_join(F.transform(tokens(text), lambda w: F.coalesce(F.try_element_at(lookup, w), w)), " ")


def unmask_stars(text: Column | str, known: Sequence[str], masked: Mapping[str, str] | None = None) -> Column:
    """Drop ``*`` inside a word if the rest is known, map masked forms, and blank all other stars. Short lists; long ones: ``dictionaries``."""
    def fix(w: Column) -> Column:
        bare = F.replace(w, F.lit("*"), F.lit(""))
        out = F.when(w.contains("*") & bare.isin(*known), bare).otherwise(w)
        for form, word in (masked or {}).items():
            out = F.when(w == form, F.lit(word)).otherwise(out)
        return out
    return F.replace(F.array_join(F.transform(tokens(text), fix), " "), F.lit("*"), F.lit(" "))


def canonical_by_substring(text: Column | str, table: Sequence[tuple[str, str]]) -> Column:
    """A token that contains a listed text becomes its canonical word; the first entry wins. Short lists; long ones: ``dictionaries``."""
    def fix(w: Column) -> Column:
        out = w
        for part, word in reversed(list(table)):
            out = F.when(w.contains(part), F.lit(word)).otherwise(out)
        return out
    return F.array_join(F.transform(F.split(_col(text), " "), fix), " ")


def fill_empty(text: Column | str, strict: bool = False, value: str = "NA") -> Column:
    # bound once: a branch of a condition is no common subexpression, and a chain before it would run twice
    return let(_col(text), lambda t: F.when(t == "" if strict else ~t.rlike(r"\S"), value).otherwise(t))


def ascii_punctuation(text: Column | str) -> Column:
    return F.translate(_col(text), FULL_WIDTH, HALF_WIDTH)


def sign_words(text: Column | str) -> Column:
    out = _col(text)
    for sign, word in SIGN_WORDS:
        out = F.replace(out, F.lit(sign), F.lit(word))
    return out


def fix_terms(text: Column | str) -> Column:
    """Drop blanks and unify domain terms."""
    out = F.replace(_col(text), F.lit(" "), F.lit(""))
    for term, word in TERM_FIXES:
        out = F.replace(out, F.lit(term), F.lit(word))
    return out


def drop_number_prefix(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"\d*[.,]", "")


def drop_list_number(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"\d*\.", "")


def after_marker(text: Column | str, marker: str = MARKER) -> Column:
    """The text behind the first marker; unchanged if the marker is absent."""
    t = _col(text)
    at = F.locate(marker, t)
    return F.when(at > 0, F.substring(t, at + len(marker), F.length(t))).otherwise(t)


def clean_record(text: Column | str) -> Column:
    """Half-width punctuation, then units, digits and subtitles out, punctuation runs to a comma."""
    return apply_rules(F.translate(_col(text), RECORD_FULL_WIDTH, RECORD_HALF_WIDTH), RECORD_RULES)


def drop_person_info(text: Column | str) -> Column:
    return apply_rules(text, PERSON_RULES)


def for_char_grams(text: Column | str) -> Column:
    """Lower case, contractions opened, punctuation and digits out, each word padded as ``#word#``."""
    spaced = F.translate(F.lower(_col(text)), "\n\t\b\r", "    ")
    # every contraction holds an apostrophe, and most texts are spared the ten scans
    opened = F.when(spaced.contains("'"), apply_rules(spaced, CHAR_GRAM_CONTRACTIONS)).otherwise(spaced)
    words = F.array_join(F.transform(F.split(F.regexp_replace(opened, r"^\s+|\s+$", ""), r"\s+"),
                                     lambda w: F.regexp_replace(w, *CHAR_GRAM_TAIL[0])), " ")
    clean = apply_rules(words, CHAR_GRAM_TAIL[1:])
    return F.concat(F.lit("#"), F.replace(clean, F.lit(" "), F.lit("# #")), F.lit("#"))


def chain(text: Column | str, steps: Sequence[Callable[[Column], Column]]) -> Column:
    out = _col(text)
    for step in steps:
        out = step(out)
    return out


# -- counted features --------------------------------------------------------------------------

# fixed values: count features of the raw text. The patterns spell out Unicode word characters,
# digits and blanks, because the plain classes of Java are ASCII only.
W, NOT_W, D, NOT_D = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]", r"\p{Nd}", r"\P{Nd}"
S, NOT_S = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]", r"[^\t-\r\x1c-\x1f\x{85}\p{Z}]"
RAW_COUNTS = {
    "ant_slash_n": r"\n",
    "raw_word_len": f"{NOT_S}+",
    "nb_upper": r"[A-Z]",
    "nb_fk": f"[Ff]{NOT_S}{{2}}[Kk]",
    "nb_sk": f"[Ss]{NOT_S}{{2}}[Kk]",
    "nb_dk": r"[dD]ick",
    "nb_you": f"{NOT_W}[Yy]ou{NOT_W}",
    "nb_mother": f"{NOT_W}mother{NOT_W}",
    "start_with_columns": r"^:+",
    "has_timestamp": f"{D}{{2}}|:{D}{{2}}",
    "has_date_long": f"{NOT_D}{D}{{2}}:{D}{{2}}, {D}{{1,2}} {W}+ {D}{{4}}",
    "has_date_short": f"{NOT_D}{D}{{1,2}} {W}+ {D}{{4}}",
    "has_http": f"https?://{NOT_S}+",
    "has_mail": r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+",
    "has_emphasize_equal": r"={2}[^\n]+={2}",
    "has_emphasize_quotes": f"\"{{4}}{NOT_S}+\"{{4}}",
}
# text that a match must hold: a quick test before the costlier patterns
REQUIRED = {"has_date_long": ":", "has_http": "http", "has_mail": "@", "has_emphasize_equal": "==",
            "has_emphasize_quotes": '""""', "nb_mother": "mother", "nb_you": "ou", "nb_dk": "ick"}
CLEAN_LENGTH_CAP = 99  # fixed value: the ratio divides by 1 + min(99, length)


def count_features(text: str, watched: Mapping[str, str] | None = None) -> dict[str, Column]:
    """Count columns of the raw text, and four of its char-gram form. ``watched`` adds patterns of
    the user's own (name to pattern)."""
    t = F.col(text)
    def count(name: str, pattern: str) -> Column:
        n = F.regexp_count(t, F.lit(pattern))
        return F.when(t.contains(REQUIRED[name]), n).otherwise(F.when(t.isNotNull(), 0)) if name in REQUIRED else n
    out = {name: count(name, p) for name, p in {**RAW_COUNTS, **(watched or {})}.items()}
    out["raw_char_len"] = F.length(t)
    clean = for_char_grams(t)
    distinct = F.size(F.array_distinct(F.split(clean, "")))
    out["clean_word_len"] = F.regexp_count(clean, F.lit(f"{NOT_S}+"))
    out["clean_char_len"] = F.length(clean)
    out["clean_chars"] = distinct
    out["clean_chars_ratio"] = distinct / (1 + F.least(F.lit(CLEAN_LENGTH_CAP), F.length(clean)))
    return out


def substring_counts(text: str, parts: Sequence[str]) -> dict[str, Column]:
    """Occurrences of each part, as a text and not as a pattern, without overlap (for many parts use ``dictionaries.part_counts``)."""
    t = F.col(text)
    return {f"n_{p}": ((F.length(t) - F.length(F.replace(t, F.lit(p), F.lit("")))) / len(p)).cast("int") for p in parts}


def longest_sentence(text: Column | str) -> Column:
    """Tokens (words and punctuation runs) in the longest sentence; sentences end at . ! or ?"""
    sentences = F.split(_col(text), r"(?<=[.!?])\s+")
    return F.array_max(F.transform(sentences, lambda s: F.regexp_count(
        s, F.lit(f"{W}+|[^\\p{{L}}\\p{{N}}_\\t-\\r\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+"))))


# -- markup and sections -----------------------------------------------------------------------

def markup_pieces(html: Column | str) -> Column:
    """Trimmed non-empty texts between ``>`` and ``<``."""
    found = F.regexp_extract_all(F.replace(_col(html), F.lit('code-system=""'), F.lit(">")),
                                 F.lit(r">{1,2}([^\n]*?)<"), F.lit(1))
    trimmed = F.transform(found, lambda x: F.regexp_replace(F.replace(x, F.lit("　"), F.lit("")), r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda x: x != "")


# fixed values: begin and end markers of the record sections
SECTIONS = {
    "diagnosis": (("初步诊断", "出院诊断"), ("医师", "出院医嘱")),
    "complaint": (("主诉", "主  诉", "主   诉"), ("现病史", "既往史")),
    "present_illness": (("现病史",), ("既往史", "入院诊断", "个人史")),
    "past_history": (("既往史",), ("个人史", "入院诊断")),
    "personal_history": (("个人史",), ("婚育史", "婚姻史", "家族史")),
    "progress": (("首次病程记录",), ("副主任医师", "记录者", "主任医师", "诊疗计划", "住院医师")),
}
DEPARTMENT_BEGIN, DEPARTMENT_END = ("科室",), ("床号", "医师")
DEPARTMENT_FORMS = ("患者入院病情评估表", "出院证", "出 院 证")
DEPARTMENT_NOISE = "一|二|三|四|五|六|七|八|九|十|科|病区|住院|护士站|东院|康馨|：|、"


def _contains_any(x: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | x.contains(w)
    return out


def _section_span(p: Column, begin: Sequence[str], end: Sequence[str],
                  body: Callable[[Column, Column], Column]) -> Column:
    """``body(start, stop)`` with the two marker positions (null if there is none)."""
    places = F.transform(p, lambda x, i: F.struct(
        i.alias("i"), (_contains_any(x, begin) & (i > 0)).alias("b"), _contains_any(x, end).alias("e")))
    index = lambda xs: F.transform(xs, lambda m: m["i"])
    return let(F.filter(places, lambda m: m["b"] | m["e"]), lambda marked: let(
        F.array_min(index(F.filter(marked, lambda m: m["b"]))), lambda first: let(
            F.array_min(index(F.filter(marked, lambda m: m["e"] & (m["i"] >= first)))), lambda stop: let(
                F.array_max(index(F.filter(marked, lambda m: m["b"] & (m["i"] <= stop)))),
                lambda start: body(start, stop)))))


def _between(p: Column, start: Column, stop: Column) -> Column:
    return F.array_join(F.slice(p, start + 2, F.greatest(stop - start - 1, F.lit(0))), "")


def section(pieces: Column | str, begin: Sequence[str], end: Sequence[str]) -> Column:
    """Text between the last begin marker and the first end marker that follows a begin marker.

    A marker in the very first piece does not begin a section; without an end the section is empty.
    """
    return let(_col(pieces), lambda p: _section_span(
        p, begin, end, lambda start, stop: F.coalesce(_between(p, start, stop), F.lit(""))))


def department(pieces: Column | str) -> Column:
    """The department named in an assessment or discharge form, without numerals and ward words."""
    behind = lambda x: F.get(F.split(x, DEPARTMENT_BEGIN[0]), F.lit(1))
    bare = lambda p, start, colon: behind(F.replace(F.get(p, start), F.lit(colon), F.lit("")))

    def named(p: Column, start: Column, stop: Column) -> Column:
        return F.when(start == stop, F.get(F.split(bare(p, start, "："), DEPARTMENT_END[0]), F.lit(0))) \
            .when(start + 1 == stop, bare(p, start, ":")).otherwise(_between(p, start, stop))

    return let(_col(pieces), lambda p: F.when(
        F.exists(p, lambda x: x.isin(*DEPARTMENT_FORMS)),
        F.coalesce(F.trim(F.regexp_replace(
            _section_span(p, DEPARTMENT_BEGIN, DEPARTMENT_END, lambda a, b: named(p, a, b)),
            DEPARTMENT_NOISE, "")), F.lit(""))).otherwise(""))


# -- topics, labels, facts ---------------------------------------------------------------------

CLAUSE_END, TOPIC_COLON = "[,;.]", ":"   # fixed values


def topic_ranges(text: Column | str, topics: Sequence[Sequence[str]]) -> Column:
    """Array of (topic, begin, end), one entry per topic found, in text order.

    The first alias present stands for its topic. A topic followed by a colon starts at itself, any
    other at its clause; each range ends where the next begins.
    """
    t = _col(text)
    hits = []
    for rank, aliases in enumerate(topics):
        hit = F.lit(None).cast("struct<begin:int,rank:int,topic:string>")
        for alias in reversed(list(aliases)):
            at = F.locate(alias, t)
            before = F.reverse(F.substring(t, F.lit(1), at - 1))
            last = F.regexp_instr(before, F.lit(CLAUSE_END))
            clause = F.when(last > 0, at - last).otherwise(0)
            begin = F.when(F.substring(t, at + len(alias), F.lit(1)) == TOPIC_COLON, at - 1).otherwise(clause)
            hit = F.when(at > 0, F.struct(begin.cast("int").alias("begin"), F.lit(rank).alias("rank"),
                                          F.lit(alias).alias("topic"))).otherwise(hit)
        hits.append(hit)
    return let(F.array_sort(F.array_compact(F.array(*hits))), lambda found: F.transform(found, lambda x, i: F.struct(
        x["topic"].alias("topic"), x["begin"].alias("begin"),
        F.coalesce(F.get(found, i + 1)["begin"], F.length(t)).alias("end"))))


def rule_label(text: Column | str, confirm: Sequence[str], hit: Sequence[str], release: Sequence[str]) -> Column:
    """1 if a confirming word occurs; else 1 for a hit without a releasing word; else 0."""
    t = _col(text)
    return F.when(_contains_any(t, confirm), 1).when(
        _contains_any(t, hit) & ~_contains_any(t, release), 1).otherwise(0)


# fixed values: words that belong to the token before them
SUFFIX_WORDS = ("病", "症", "后", "型", "期", "史", "程", "级", "性", "区", "周", "天", "方案", "分")
TIME_WORDS = ("年", "余年", "年余", "月", "余月", "月余", "周", "余周", "周余", "天", "余天", "天余",
              "日", "余日", "日余", "小时", "分钟", "分", "次")
JOINER = "\x1f"   # unit separator: tokens do not contain it


def join_suffix_words(words: Column | str) -> Column:
    """Append suffix words to the token before them. One linear pass over the joined tokens: the
    separator in front of a listed word is removed."""
    glued = F.regexp_replace(F.array_join(_col(words), JOINER),
                             f"{JOINER}(?=(?:{'|'.join(SUFFIX_WORDS)})(?:{JOINER}|$))", "")
    return F.split(glued, JOINER)


def join_time_words(words: Column | str) -> Column:
    """Append time words to the token before them if that token is an integer."""
    glued = F.regexp_replace(F.array_join(_col(words), JOINER),
                             f"(^|{JOINER})([-+]?[0-9]+){JOINER}({'|'.join(TIME_WORDS)})(?={JOINER}|$)", "$1$2$3")
    return F.split(glued, JOINER)


# fixed values: negation words of the clause rule
DENY_WORDS = ("不伴", "未见", "未", "无", "不", "未见异常")


def clause_facts(text: Column | str, items: Sequence[str], deny: Sequence[str] = DENY_WORDS) -> Column:
    """Array of (clause, item, negated): an item is negated if a deny word stands before it in its
    clause."""
    clauses = F.split(_col(text), CLAUSE_END)
    def of_clause(c: Column, i: Column) -> Column:
        entries = []
        for item in items:
            before = F.substring(c, F.lit(1), F.locate(item, c) - 1)
            entries.append(F.when(c.contains(item), F.struct(
                i.alias("clause"), F.lit(item).alias("item"), _contains_any(before, deny).alias("negated"))))
        return F.array_compact(F.array(*entries))
    return F.flatten(F.transform(clauses, of_clause))


# -- characters as ids -------------------------------------------------------------------------

# fixed value: the alphabet of the character ids, first character = 1
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-,;.!?:'\"/\\|_@#$%^&*~`+-=<>()[]{}"


def tail_char_ids(text: Column | str, n: int, alphabet: str = ALPHABET) -> Column:
    """Ids of the last n characters, last first; 0 for unknown characters and as padding.

    A character that the alphabet lists twice has the id of its later place.
    """
    last_place = {c: i + 1 for i, c in enumerate(alphabet)}
    lookup = F.create_map(*[x for c, i in last_place.items() for x in (F.lit(c), F.lit(i))])
    chars = F.reverse(F.split(F.right(F.lower(_col(text)), F.lit(n)), ""))
    ids = F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(lookup, c), F.lit(0)))
    return F.concat(ids, F.array_repeat(F.lit(0), F.lit(n) - F.size(ids)))
