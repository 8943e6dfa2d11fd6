"""Quality rules whose limits follow the data: mergeable quantile sketches per language and source.

Counts per document are taken over the whole text. A sketch per (language, source) and
ratio says where its median and upper tail lie; a document fails if a ratio lies far above
the tail, and by more than one count in its own length. Groups with few documents take the limits of their language, and languages
with few those of all documents: the sketches are merged, the texts are read once.

Nulls: a null text has no words and fails the base rule; null language or source is a
group of its own. Repeated rows are judged alike. An empty table gives an empty result.
"""

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from greenlattice.llm.common import column_safe, keep, query, release, small, table

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Ratio, and what one count of it is in how many of the document's units.
RATIOS = {"symbol_ratio": (1, "n_words"), "repeat_ratio": (2 * WINDOW, "n_words"), "dup_line_ratio": (1, "n_lines"),
          "caps_ratio": (1, "word_chars"), "exclaim_ratio": (1, "n_words")}
TAIL = 0.9  # quantile of a group
FENCE = 5.0  # times its distance from the median above it
LEAST = 200  # documents from which a group has limits of its own
SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "n_lines long, n_caps long, n_exclaims long")
FIELDS = [c.split()[0] for c in SCHEMA.split(", ")]


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a five-word window found twice or more."""
    grams = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(grams)) == len(grams):
        return 0
    times = Counter(grams)
    covered = end = 0
    for at, gram in enumerate(grams):
        if times[gram] > 1:
            covered += at + WINDOW - max(at, end)
            end = at + WINDOW
    return covered


def text_counts(text: str) -> tuple[int, ...]:
    """The counts of one text, in the order of ``SCHEMA``."""
    words = text.encode("utf-8", "replace").split()
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    return (len(words), len(text) - sum(map(text.count, SPACE)) if words else 0, sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words), len(lines),
            0 if text.islower() else sum(map(str.isupper, text)), text.count("!"))


def _count_texts(texts: pa.Array) -> pa.Array:
    """Counts per text; one text at a time is a Python string."""
    columns = list(zip(*(text_counts(t.as_py() or "") for t in texts))) or [()] * len(FIELDS)
    release()
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=FIELDS)


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with one struct ``_counts`` of the counts and ratios of each text."""
    c = F.col("_raw")
    words, lines = F.greatest(c.n_words, F.lit(1)), F.greatest(c.n_lines, F.lit(1))
    ratios = {"symbol_ratio": c.n_symbols / words, "repeat_ratio": c.n_repeat_words / words,
              "dup_line_ratio": c.n_dup_lines / lines, "exclaim_ratio": c.n_exclaims / words,
              "caps_ratio": c.n_caps / F.greatest(c.word_chars, F.lit(1))}
    fields = [c[name].alias(name) for name in [*COUNTS, "n_lines"]] + [ratios[name].alias(name) for name in RATIOS]
    return docs.withColumn("_raw", F.arrow_udf(_count_texts, SCHEMA)("text")).withColumn("_counts", F.struct(*fields)).drop("_raw")


def base_failed(c: Column) -> Column:
    """Too few words, or a fifth of them in repeated windows."""
    return (c.n_words < 10) | (100 * c.n_repeat_words > 20 * c.n_words)


def limits(counted: DataFrame) -> DataFrame:
    """Upper limit of every ratio per (lang, source), stored: rows grow with groups only.

    ``counted`` has lang, source and ``_counts``. Sketches are built where the rows are and
    merged group by group, so a source with a third of the rows costs no task more.
    """
    leaf = keep(counted.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(F.col(f"_counts.{r}")).alias(r) for r in RATIOS]))
    merged = [F.kll_merge_agg_double(r).alias(r) for r in RATIOS]
    by_lang = leaf.groupBy("lang").agg(F.sum("n").alias("n"), *merged)
    whole = leaf.agg(F.sum("n").alias("n"), *merged)

    def fences(df: DataFrame, tag: str, *by: Column | str) -> DataFrame:
        out = []
        for r in RATIOS:
            mid, high = (F.kll_sketch_get_quantile_double(F.col(r), F.lit(q)) for q in (0.5, TAIL))
            out.append((high + FENCE * (high - mid)).alias(f"{tag}_{r}"))
        return df.select(*by, F.col("n").alias(f"{tag}_n"), *out)

    # no rows, no sketch to ask
    top = fences(whole, "all").first() if whole.first()["n"] else dict.fromkeys((f"all_{r}" for r in RATIOS))
    joined = (fences(leaf, "own", "lang", "source").alias("a")
              .join(fences(by_lang, "lang", F.col("lang").alias("_lang")), F.col("a.lang").eqNullSafe(F.col("_lang"))))
    return keep(joined.select(F.col("a.lang").alias("_lang"), F.col("a.source").alias("_source"), *[
        F.when(F.col("own_n") >= LEAST, F.col(f"own_{r}")).when(F.col("lang_n") >= LEAST, F.col(f"lang_{r}"))
        .otherwise(F.lit(top[f"all_{r}"]).cast("double")).alias(f"_most_{r}") for r in RATIOS]))


def judge(counted: DataFrame, fences: DataFrame) -> DataFrame:
    """``counted`` with base_failed and kept, by the limits of each row's group."""
    on = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    c = F.col("_counts")
    within = F.lit(True)
    for r, (count, units) in RATIOS.items():
        one = count / F.greatest(c[units], F.lit(1))
        within = within & (c[r] <= F.greatest(F.col(f"_most_{r}"), one) + 1e-12)
    joined = counted.join(small(fences), on, "left")
    return (joined.withColumn("_failed", base_failed(c))
            .withColumn("_kept", ~F.col("_failed") & F.coalesce(within, F.lit(True)))
            .drop("_lang", "_source", *[f"_most_{r}" for r in RATIOS]))


def with_groups(docs: DataFrame) -> DataFrame:
    """``docs`` with the lang and source columns that grouping needs, null where absent."""
    missing = {c: F.lit(None).cast("string") for c in ("lang", "source") if c not in docs.columns}
    return docs.withColumns(missing) if missing else docs


def quality(docs: DataFrame) -> DataFrame:
    """Counts and verdict per document."""
    docs = with_groups(docs).select("doc_id", "text", "lang", "source")
    counted = keep(with_counts(docs).drop("text"))
    return judge(counted, limits(counted)).select(
        "doc_id", *[F.col(f"_counts.{c}").alias(c) for c in COUNTS], F.col("_failed").alias("base_failed"),
        F.col("_kept").alias("kept"), *[F.col(f"_counts.{r}").alias(r) for r in RATIOS])


@column_safe
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go.

    The documents are stored with their counts, so that texts are counted once; limits read the counts only.
    """
    counted = keep(with_counts(with_groups(docs)))
    fences = limits(counted.select("lang", "source", "_counts"))
    return judge(counted, fences).where("_kept").select(*docs.columns)


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
