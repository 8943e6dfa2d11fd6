"""Secret scan over a trigram inverted index, in DataFrame functions alone.

From each rule's regular expression follow the trigrams that every match must hold, as an
AND of ORs of ANDs. The index has a posting (trigram, row) for each such trigram that a
lower-cased text holds. Intersecting the postings gives the rows a rule can match in; only
these run its expression. A rule without mandatory trigrams (``hex``) scans every text.

A row is named by a 64-bit key of its id and text. A collision only makes a rule look at a
text without need, since the expression decides. Candidates are broadcast only up to a
counted size, else joined by key.

Nulls: a null text has no secrets. Repeated rows get the same answer. Overlapping spans of
different kinds are all reported; ``redacted`` replaces their union. An empty table gives an
empty result.
"""

from __future__ import annotations

from re import _constants as rc
from re import _parser as rp
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from greenlattice.llm.common import column_safe, keep, query, row_key, small, table, text_of


class Rule(NamedTuple):
    kind: str
    regex: str
    group: int = 0  # the group whose length decides
    least: int = 0  # code points that it has at least
    base: bool = False


#: In the order in which ties are listed; the first three are the fixed base.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
KINDS = [r.kind for r in RULES]


def trigram_query(regex: str) -> list[list[frozenset[str]]]:
    """Clauses that all hold in a lower-cased text with a match; in each, one set of trigrams does."""
    clauses: list[list[frozenset[str]]] = []

    def trigrams(literal: str) -> frozenset[str]:
        return frozenset(literal[i:i + 3] for i in range(len(literal) - 2))

    def walk(items) -> None:
        run = ""
        for op, value in [*items, (None, None)]:
            if op is rc.LITERAL:
                run += chr(value).lower()
                continue
            if len(run) >= 3:
                clauses.append([trigrams(run)])
            run = ""
            if op is rc.SUBPATTERN:
                walk(value[3])
            elif op is rc.MAX_REPEAT and value[0] >= 1:
                walk(value[2])
            elif op is rc.BRANCH:
                ways = [mandatory(way) for way in value[1]]
                if all(ways):  # a way without a trigram would let any text through
                    clauses.append(ways)

    def mandatory(items) -> frozenset[str]:
        outer = list(clauses)
        clauses.clear()
        walk(items)
        single = [c[0] for c in clauses if len(c) == 1]
        clauses[:] = outer
        return frozenset().union(*single) if single else frozenset()

    walk(rp.parse(regex))
    return clauses


def postings(texts: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, _key): which of the trigrams each lower-cased text holds."""
    low = F.lower("_text")
    hits = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in grams]))
    return texts.select("_key", F.explode(hits).alias("gram"))


def candidates(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(_row, _rules) stored: the rows and the indexed rules that can match in them."""
    spark = docs.sparkSession
    wanted = [(rule.kind, clause, way, gram, len(grams))
              for rule in RULES for clause, ways in enumerate(trigram_query(rule.regex))
              for way, grams in enumerate(ways) for gram in sorted(grams)]
    clauses = {rule.kind: len(trigram_query(rule.regex)) for rule in RULES}
    asked = spark.createDataFrame([(*w, clauses[w[0]]) for w in wanted],
                                  "kind string, clause int, way int, gram string, need int, clauses int")
    index = postings(docs.select(row_key(id_column).alias("_key"), text_of().alias("_text")), sorted({w[3] for w in wanted}))
    # a row's postings meet by row, so a trigram that every text holds is no hot key
    ways = index.join(F.broadcast(asked), "gram").groupBy("_key", "kind", "clause", "way", "need", "clauses").agg(
        F.count_distinct("gram").alias("n")).where("n = need")
    rules = ways.groupBy("_key", "kind", "clauses").agg(F.count_distinct("clause").alias("n")).where("n = clauses")
    return keep(rules.groupBy(F.col("_key").alias("_row")).agg(F.collect_set("kind").alias("_rules")))


def spans_of(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches that are long enough: array of (start, number of the kind, end)."""
    number = KINDS.index(rule.kind)
    regex = F.lit(rule.regex)
    found = F.regexp_extract_all(text, regex, F.lit(0))
    judged = F.regexp_extract_all(text, regex, F.lit(rule.group))
    between = F.split(text, rule.regex, -1)
    steps = F.zip_with(F.slice(between, 1, F.size(found)), F.arrays_zip(found.alias("f"), judged.alias("g")), lambda b, m: F.struct(
        F.length(b).cast("long").alias("skip"), F.length(m["f"]).cast("long").alias("long"), (F.length(m["g"]) >= rule.least).alias("holds")))
    span = "struct<start:bigint,kind:int,end:bigint>"
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{span}>").alias("out")).cast(f"struct<at:bigint,out:array<{span}>>")

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["skip"]
        one = F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + m["long"]).alias("end")).cast(span)
        return F.struct((start + m["long"]).alias("at"), F.when(m["holds"], F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out")
                        ).cast(f"struct<at:bigint,out:array<{span}>>")

    return F.aggregate(steps, begin, step, lambda acc: acc["out"])


def scan(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with ``_spans``: (start, kind, end) of all rules by start, then kind."""
    found = candidates(docs, id_column)
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    text = text_of()
    parts = []
    for rule in RULES:
        if trigram_query(rule.regex):
            may = F.coalesce(F.array_contains("_rules", rule.kind), F.lit(False))
        else:
            may = F.rlike(text, F.lit(rule.regex))
        parts.append(F.when(may, spans_of(text, rule)).otherwise(none))
    joined = docs.withColumn("_secrets_key", row_key(id_column)).join(small(found), F.col("_secrets_key") == F.col("_row"), "left")
    return joined.withColumn("_spans", F.array_sort(F.concat(*parts))).drop("_secrets_key", "_row", "_rules")


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every maximal run of overlapping spans replaced by the name of its first."""
    names = F.array(*map(F.lit, KINDS))
    state = "struct<at:bigint,out:array<string>>"

    def cut(start: Column, end: Column) -> Column:
        return F.substr(text, (start + 1).cast("int"), (end - start).cast("int"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.array(cut(acc["at"], s["start"]), F.concat(F.lit("<"), F.element_at(names, s["kind"] + 1), F.lit(">"))))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out")).cast(state)

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")).cast(state)
    new = F.aggregate(spans, begin, step, lambda acc: F.concat(F.array_join(acc["out"], ""), cut(acc["at"], F.length(text).cast("long"))))
    return F.when(F.size(spans) > 0, new).otherwise(text)


@column_safe
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets in the texts are replaced by the name of their kind; all documents stay."""
    found = scan(docs).withColumn("text", redacted(F.col("text"), F.col("_spans")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size("_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def _oracle() -> str:
    kinds = []
    for number, rule in enumerate(RULES):
        regex = rule.regex.replace("'", "''")
        kinds.append(f"""SELECT rid, {number} AS kno, '{rule.kind}' AS kind, i,
  length(ms[i]) AS len, length(gs[i]) AS glen, {rule.least} AS least,
  CAST(coalesce(list_sum([length(x) FOR x IN ps[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN ms[1:i - 1]]), 0) AS BIGINT) AS start
FROM (SELECT rid, ps, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
  SELECT rid, string_split_regex(t, '{regex}') AS ps, regexp_extract_all(t, '{regex}') AS ms,
    regexp_extract_all(t, '{regex}', {rule.group}) AS gs FROM d WHERE regexp_matches(t, '{regex}')))""")
    base = "kind IN ('assign', 'access', 'hex')"
    item = "kind || ':' || CAST(start AS VARCHAR) || ':' || CAST(start + len AS VARCHAR)"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(kinds)}),
a AS (SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
  count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg({item}, ',' ORDER BY start, kno) FILTER (WHERE {base}) AS base, string_agg({item}, ',' ORDER BY start, kno) AS spans
  FROM s WHERE glen >= least GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)"""


@query("op3_secrets", _oracle())
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("_spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("_spans", lambda s: s["kind"] < sum(r.base for r in RULES))
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))
