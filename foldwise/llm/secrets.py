"""Secret scans with a trigram inverted index, in DataFrame functions only.

Each rule is a regular expression. What it must contain is derived from its
syntax tree as a Boolean query: alternatives of sets of lower-case trigrams.
The index lists, for each trigram that some rule needs, the texts that contain
it, in blocks of bounded size. A rule's postings are intersected within each
alternative and united over alternatives; only these texts are verified with
the rule itself. A rule with an alternative that needs no trigram is verified
on every text.

Texts are indexed under their hash, so copies share a posting; two texts with
one hash are candidates of each other's rules, and verification decides.

Defined results: a null text is empty and holds nothing; repeated rows are
scanned one by one; the character U+0001 is treated as U+0002, which no rule
matches; spans are sorted by start, then by the order of the rules.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame, functions as F

from foldwise.llm.words import quoted
from foldwise.session import settle

# texts in one block of the postings
BLOCK_TEXTS = 20_000
# alternatives of one rule beyond which a part of it counts as unknown
MAX_ALTERNATIVES = 64
GAP = "\0"
MARK = "\x01"


@dataclass(frozen=True)
class Rule:
    """A kind of secret; matches whose group ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# fixed values: the kinds and their patterns, in the order that sorts spans with one start
BASE_RULES = [
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
]
MORE_RULES = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
]
RULES = BASE_RULES + MORE_RULES


def _alternatives(tree) -> set[str]:
    """Strings with gaps, one of which every match looks like."""
    out = {""}
    for op, arg in tree:
        if op is sre.LITERAL:
            here = {chr(arg)}
        elif op is sre.IN and len(arg) <= 8 and all(o is sre.LITERAL for o, _ in arg):
            here = {chr(a) for _, a in arg}
        elif op is sre.BRANCH:
            here = set().union(*[_alternatives(b) for b in arg[1]])
        elif op is sre.SUBPATTERN:
            here = _alternatives(arg[-1])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, sub = arg
            inner = _alternatives(sub)
            if (least, most) == (0, 1):
                here = inner | {""}
            elif least == 0:
                here = {GAP}
            else:
                here = inner if least == most == 1 else {s + GAP for s in inner}
        elif op is sre.AT:
            here = {""}
        else:  # classes, any character, look-around and the rest: nothing is known
            here = {GAP}
        if len(out) * len(here) > MAX_ALTERNATIVES:
            here = {GAP}
        out = {a + b for a in out for b in here}
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Sets of lower-case trigrams; every match contains all of at least one set. None: nothing is mandatory."""
    query = set()
    for text in _alternatives(_parser.parse(pattern)):
        grams = {
            piece[i : i + 3].lower() for piece in text.split(GAP) if piece.isascii() for i in range(len(piece) - 2)
        }
        if not grams:
            return None
        query.add(frozenset(grams))
    # a set that contains another one adds nothing
    return sorted((a for a in query if not any(b < a for b in query)), key=sorted)


def _text(df: DataFrame, text: str) -> Column:
    return F.translate(F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")), MARK, "\x02")


def build_index(df: DataFrame, text: str, rules: Sequence[Rule]) -> DataFrame:
    """Postings: for each trigram of the rules' queries and each block of texts the hashes of the texts."""
    grams = sorted({g for rule in rules for option in trigram_query(rule.pattern) or [] for g in option})
    n_blocks = -(-df.count() // BLOCK_TEXTS) or 1
    low = F.lower(F.col("t"))
    present = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), g) for g in grams]))
    return (
        df.select(_text(df, text).alias("t"))
        .select(F.xxhash64("t").alias("key"), F.explode(present).alias("gram"))
        .groupBy("gram", F.pmod("key", F.lit(n_blocks)).alias("block"))
        .agg(F.collect_set("key").alias("keys"))
    )


def _tagged(kind: str):
    return lambda key: F.struct(key.alias("key"), F.lit(kind).alias("kind"))


def candidates(postings: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Text hashes with the kinds whose trigram query they meet."""
    queries = {rule.kind: q for rule in rules if (q := trigram_query(rule.pattern)) is not None}
    grams = sorted({g for q in queries.values() for option in q for g in option})
    names = {g: f"g{i}" for i, g in enumerate(grams)}
    # one row per block: a list of bounded length for each trigram
    blocks = postings.groupBy("block").agg(
        *[F.first(F.when(F.col("gram") == g, F.col("keys")), ignorenulls=True).alias(names[g]) for g in grams]
    )
    nothing = F.array().cast("array<bigint>")
    found = []
    for kind, query in queries.items():
        options = []
        for option in query:
            lists = [F.coalesce(names[g], nothing) for g in sorted(option)]
            keys = lists[0]
            for other in lists[1:]:
                keys = F.array_intersect(keys, other)
            options.append(keys)
        united = options[0]
        for other in options[1:]:
            united = F.array_union(united, other)
        found.append(F.transform(united, _tagged(kind)))
    pairs = blocks.select(F.explode(F.concat(*found)).alias("p")).select("p.*")
    return pairs.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _parts(text: Column, rule: Rule) -> Column:
    """The text cut at the matches of the rule: pieces between matches at even places, matches at odd ones."""
    return F.split(F.regexp_replace(text, F.lit(rule.pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)


def _passes(match: Column, rule: Rule) -> Column:
    if not rule.least:
        return F.lit(True)
    return F.length(F.regexp_extract(match, rule.pattern, rule.group)) >= rule.least


def _spans(text: Column, rule: Rule, place: int) -> Column:
    kind = "array<struct<start:int,place:int,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), F.array().cast(kind).alias("spans"))

    def step(state, part):
        end = state["at"] + F.length(part)
        span = F.array(F.struct(state["at"].alias("start"), F.lit(place).alias("place"), end.alias("end")))
        spans = F.when(state["odd"] & _passes(part, rule), F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), (~state["odd"]).alias("odd"), spans.alias("spans"))

    return F.aggregate(_parts(text, rule), start, step, lambda state: state["spans"])


def _with_candidates(df: DataFrame, text: str, rules: Sequence[Rule]) -> DataFrame:
    found = settle(candidates(build_index(df, text, rules), rules))
    keyed = df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"), _text(df, text).alias("t"))
    return keyed.withColumn("key", F.xxhash64("t")).join(found, "key", "left")


def _verify(rule: Rule) -> Column:
    """True where the rule has to look at the text."""
    if trigram_query(rule.pattern) is None:
        return F.col("t").rlike(rule.pattern)
    return F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))


def find_secrets(df: DataFrame, text: str = "text", rules: Sequence[Rule] = tuple(RULES), out: str = "secrets") -> DataFrame:
    """Adds ``out``: an array of (start, place, end), place being the rule's number. A column of that name is replaced."""
    nothing = F.array().cast("array<struct<start:int,place:int,end:int>>")
    spans = [F.when(_verify(rule), _spans(F.col("t"), rule, i)).otherwise(nothing) for i, rule in enumerate(rules)]
    kept = [F.col("row").getField(c).alias(c) for c in df.columns if c != out]
    return _with_candidates(df, text, rules).select(*kept, F.array_sort(F.concat(*spans)).alias(out))


def _without(t: Column, spans: Column, put: str) -> Column:
    """The text with ``put`` in place of each stretch that overlapping spans (sorted by start) cover together."""

    def step(done: Column, s: Column) -> Column:
        between = F.concat(F.substring(t, done["at"] + 1, s["start"] - done["at"]), F.lit(put))
        text = F.concat(done["text"], F.when(s["start"] >= done["at"], between).otherwise(F.lit("")))
        return F.struct(text.alias("text"), F.greatest(done["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    return F.aggregate(spans, start, step, lambda done: F.concat(done["text"], F.substring(t, done["at"] + 1, F.length(t))))


def redact(
    df: DataFrame,
    text: str = "text",
    rules: Sequence[Rule] = tuple(RULES),
    put: str = "[secret]",
    length: str | None = None,
) -> DataFrame:
    """The same rows and columns; every stretch of the text that secrets cover is replaced by ``put``.

    ``length`` names a column that holds the length of the text and changes with it.
    """
    nothing = F.array().cast("array<struct<start:int,place:int,end:int>>")
    spans = [F.when(_verify(rule), _spans(F.col("t"), rule, i)).otherwise(nothing) for i, rule in enumerate(rules)]
    # all spans are found in the text as it came: a rule does not see what another one has put
    made = _with_candidates(df, text, rules).select("row", "t", F.array_sort(F.concat(*spans)).alias("spans"))
    touched, whole = F.size("spans") > 0, F.col("row").getField(text).cast("string")
    made = made.select("row", touched.alias("touched"), F.when(touched, _without(whole, F.col("spans"), put)).alias("clean"))
    columns = []
    for c in df.columns:
        old = F.col("row").getField(c)
        if c == text:
            old = F.when(F.col("touched"), F.col("clean")).otherwise(old)
        elif c == length:
            old = F.when(F.col("touched"), F.length("clean").cast(df.schema[c].dataType)).otherwise(old)
        columns.append(old.alias(c))
    return made.select(*columns)


def span_text(spans: Column, rules: Sequence[Rule]) -> Column:
    """kind:start:end of all spans, joined by commas."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["place"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def digest(found: DataFrame, out: str = "secrets", rules: Sequence[Rule] = tuple(RULES)) -> DataFrame:
    spans = F.col(quoted(out))
    n = len(BASE_RULES)
    count = lambda i: F.size(F.filter(spans, lambda s: s["place"] == i)).cast("long")
    base = F.filter(spans, lambda s: s["place"] < n)
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{rule.kind}") for i, rule in enumerate(BASE_RULES)],
        F.sha2(span_text(base, rules), 256).alias("base_sha256"),
        span_text(spans, rules).alias("spans"),
    )


def _either_case(pattern: str) -> str:
    """The pattern with its case-insensitive group written as classes, for an engine that folds more letters."""
    inside = re.search(r"\(\?i:(.*?\))\)", pattern)
    if not inside:
        return pattern
    letters = re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", inside[1])
    return pattern.replace(inside[0], letters)


def oracle(rules: Sequence[Rule] = tuple(RULES)) -> str:
    """DuckDB SQL for the digest: the same cuts at matches, offsets from the lengths of the pieces before."""
    lists = []
    for i, rule in enumerate(rules):
        pattern = _either_case(rule.pattern).replace("'", "''")
        parts = f"string_split(regexp_replace(t, '{pattern}', chr(1) || '\\0' || chr(1), 'g'), chr(1))"
        passes = f"length(regexp_extract(p[2 * i], '{pattern}', {rule.group})) >= {rule.least}"
        lists.append(f"""
    (SELECT list({{'start': s, 'place': {i}, 'stop': s + length(p[2 * i])}}) FROM (
      SELECT p, i, list_sum([length(x) for x in p[1:2 * i - 1]])::BIGINT AS s
      FROM (SELECT {parts} AS p), LATERAL (SELECT unnest(range(1, len(p) // 2 + 1)) AS i)) WHERE {passes})""")
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"
    joined = lambda among: f"coalesce(array_to_string([{kinds}[x.place + 1] || ':' || x.start || ':' || x.stop for x in {among}], ','), '')"
    n = len(BASE_RULES)
    counts = ", ".join(f"len([x for x in spans if x.place = {i}])::BIGINT AS n_{r.kind}" for i, r in enumerate(BASE_RULES))
    union = " || ".join(f"coalesce({x}, [])" for x in lists)
    return f"""
WITH d AS (SELECT doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
f AS (SELECT doc_id, list_sort({union}) AS spans FROM d)
SELECT doc_id, {counts}, sha256({joined(f'[x for x in spans if x.place < {n}]')}) AS base_sha256, {joined('spans')} AS spans
FROM f"""
