"""Secret scans over a trigram inverted index, with DataFrame functions only.

For each rule's pattern the driver derives a Boolean trigram query: alternatives of trigrams that every match must
contain. One pass over each text finds the trigrams that some query names; these postings (trigram, document) are
intersected by key, and only the documents that satisfy a rule's query are verified with its pattern. Rules without
mandatory trigrams scan every text. Texts are not shuffled where the candidates' keys are few enough to be broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby, product

try:
    from re import _parser as sre
except ImportError:  # older interpreters
    import sre_parse as sre
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsefield.llm.common import BROADCAST_BYTES, checkpoint


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern; those whose `group` has fewer than `least` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The base rules as the contract states them. A run of one class is as long as can be, so its least
#: length may stand in the pattern.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
)
RULES = (
    *BASE,
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
#: More alternatives than this and a pattern part counts as unknown text.
MOST = 64


def fragments(tree) -> list[tuple[str | None, ...]]:
    """Alternatives of a pattern as literal strings with None for unknown text between them."""
    alts: list[tuple] = [()]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            part = [(chr(arg).lower(),)]
        elif name == "SUBPATTERN":
            part = fragments(arg[-1])
        elif name == "BRANCH":
            part = [a for branch in arg[1] for a in fragments(branch)]
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            part = [(c,) for c in sorted({chr(v).lower() for _, v in arg})]
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[:2] == (0, 1):
            part = [(), *fragments(arg[2])]
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            part = [(*a, None) for a in fragments(arg[2])]
        elif name == "AT":
            part = [()]
        else:
            part = [(None,)]
        if len(part) > 6 and all(len(a) == 1 for a in part) or len(part) * len(alts) > MOST:
            part = [(None,)]
        alts = list(dict.fromkeys((*a, *b) for a, b in product(alts, part)))
    return alts


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of lower-cased trigrams, one of which must be wholly in any text that matches; None if there are none."""
    out: set[frozenset[str]] = set()
    for alt in fragments(sre.parse(pattern)):
        runs = "".join("\0" if p is None else p for p in alt).split("\0")
        grams = frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2))
        if not grams:
            return None
        out.add(grams)
    return sorted((a for a in out if not any(b < a for b in out)), key=sorted)


def any_of(grams: list[str]) -> str:
    """A pattern that captures each trigram in `grams` wherever it stands, overlapping ones too."""
    escaped = lambda c: "\\" + c if not c.isalnum() and c != "_" else c
    parts = []
    for first, some in groupby(sorted(grams), key=lambda g: g[0]):
        rest = [f"{escaped(second)}[{''.join(escaped(g[2]) for g in more)}]" for second, more in groupby(some, key=lambda g: g[1])]
        parts.append(f"{escaped(first)}(?:{'|'.join(rest)})")
    return f"(?=({'|'.join(parts)}))"


def candidates(docs: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """key, rules: a bit for each rule whose trigram query the document satisfies."""
    grams = sorted({g for q in queries.values() for alt in q for g in alt})
    wants = [(g, r, a, i, len(alt)) for r, q in queries.items() for a, alt in enumerate(q) for i, g in enumerate(sorted(alt))]
    use = lambda w: F.struct(*(F.lit(x).alias(n) for x, n in zip(w[1:], ("rule", "alt", "bit", "need"), strict=True)))
    uses = F.create_map(*[c for g in grams for c in (F.lit(g), F.array(*[use(w) for w in wants if w[0] == g]))])
    postings = docs.select("key", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(any_of(grams)), F.lit(1)))).alias("gram"))
    hits = postings.select("key", F.explode(F.element_at(uses, F.col("gram"))).alias("u")).select("key", "u.*")
    whole = hits.groupBy("key", "rule", "alt", "need").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("got")).where("got = shiftleft(1L, need) - 1")
    return whole.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


#: Matches whose spans are gathered together.
BLOCK = 256
SPANS = "array<struct<start:int,kind:int,end:int>>"


def none() -> Column:
    return F.array().cast(SPANS)


def matches(text: Column, n: int, rule: Rule) -> Column:
    """The rule's matches as structs start, kind (its number) and end, in code points."""
    found, between = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    parts = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("hit"), value.alias("value"))
    # Spans are gathered by blocks, as an array that grows match by match would be copied as often.
    blocks = F.transform(F.sequence(F.lit(0), ((F.size(parts) - 1) / BLOCK).cast("int")), lambda k: F.slice(parts, (k * BLOCK + 1).cast("int"), BLOCK))

    def add(state, p):
        start = state["at"] + F.length(p["gap"])
        end = start + F.length(p["hit"])
        span = F.array(F.struct(start.alias("start"), F.lit(n).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(p["value"]) >= rule.least, F.concat(state["out"], span)).otherwise(state["out"]).alias("out"))

    def add_block(state, block):
        got = F.aggregate(block, F.struct(state["at"].alias("at"), none().alias("out")), add)
        return F.struct(got["at"].alias("at"), F.concat(state["out"], F.array(got["out"])).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out"))
    return F.when(text.rlike(rule.pattern), F.aggregate(blocks, start, add_block, lambda s: F.flatten(s["out"]))).otherwise(none())


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """keep columns, n_<kind> of the base rules, base_sha256, spans (all rules) of every row; spans are kind:start:end.

    Null and empty texts have no spans; repeated rows stay; an empty table gives no rows; other input columns, whatever
    their names, are not read. Spans are ordered by start, then by the rules' order.
    """
    queries = {n: trigram_query(r.pattern) for n, r in enumerate(rules)}
    docs = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keep)], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.xxhash64(*docs.columns))  # equal rows share it, so they get the same candidates
    indexed = {n: q for n, q in queries.items() if q}
    if indexed:
        found = checkpoint(candidates(docs, indexed).withColumnRenamed("key", "found"))
        hint = F.broadcast if found.count() * 24 <= broadcast_bytes else (lambda x: x)
        docs = docs.join(hint(found), F.col("key") == F.col("found"), "left")
    else:
        docs = docs.withColumn("rules", F.lit(0))
    cols = [F.when(F.expr(f"rules & {1 << n}L") != 0, matches(F.col("text"), n, r)).otherwise(none()) if n in indexed else matches(F.col("text"), n, r) for n, r in enumerate(rules)]
    out = docs.select(*[f"__k{i}" for i in range(len(keep))], *[c.alias(f"m{n}") for n, c in enumerate(cols)])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    show = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = [n for n, r in enumerate(rules) if r.base]
    return out.select(
        *[F.col(f"__k{i}").alias(k) for i, k in enumerate(keep)],
        *[F.size(f"m{n}").cast("long").alias(f"n_{rules[n].kind}") for n in base],
        F.sha2(show(F.concat(*[F.col(f"m{n}") for n in base])), 256).alias("base_sha256"),
        show(F.concat(*[F.col(f"m{n}") for n in range(len(rules))])).alias("spans"),
    )


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same rows as DuckDB SQL, every pattern over every text."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    found = ", ".join(f"regexp_extract_all(t, {q(r.pattern)}, 0) AS h{n}, string_split_regex(t, {q(r.pattern)}) AS g{n}, regexp_extract_all(t, {q(r.pattern)}, {r.group}) AS v{n}" for n, r in enumerate(rules))
    span = lambda n, r: f"list_transform(list_filter(range(1, len(h{n}) + 1), lambda i: length(v{n}[i]) >= {r.least}), lambda i: {{'s': list_sum(list_transform(g{n}[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(h{n}[1:i-1], lambda x: length(x))), 0)::BIGINT, 'k': {n}, 'n': length(h{n}[i])}})"
    spans = ", ".join(f"{span(n, r)} AS m{n}" for n, r in enumerate(rules))
    kinds = "[" + ", ".join(q(r.kind) for r in rules) + "]"
    show = lambda which: f"array_to_string(list_transform(list_sort({' || '.join(f'm{n}' for n in which)}), lambda x: {kinds}[x.k + 1] || ':' || x.s || ':' || (x.s + x.n)), ',')"
    base = [n for n, r in enumerate(rules) if r.base]
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, {found} FROM d), m AS (SELECT doc_id, {spans} FROM f)
SELECT doc_id, {", ".join(f"len(m{n}) AS n_{rules[n].kind}" for n in base)}, sha256({show(base)}) AS base_sha256, {show(range(len(rules)))} AS spans FROM m
"""
