"""Quality rules with host verdicts, in DataFrame expressions only.

Each row gets counts of its whole text and a base verdict. Failures of the
base rules are summed by host, the host rates are shrunk towards the mean of
all hosts with an empirical beta prior (fitted by moments), and hosts whose
shrunk failure rate is above ``max_host_rate`` take all their rows with them.

Defined results: a null or empty text has no words and fails the base rules;
a row with a null host is judged by the base rules alone; repeated rows count
each on its own; an empty table gives an empty result; columns of the input
that carry the name of an output column are replaced. Words are maximal runs
of characters other than space and tab to carriage return, of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_lookup, materialize

MIN_WORDS = 50
#: A text fails when more than this percentage of its words repeat in windows.
MAX_REPEAT_PERCENT = 50
#: A host is rejected when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's strength, in rows.
PRIOR_ROWS = (1.0, 1e6)

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]

_SPACE = " \\t\\n\\u000B\\u000C\\r"
#: Positions of the 3-word windows that occur again, counted as covered words.
#: The outer transform binds the sorted windows once for the inner lambdas.
_REPEATS = """
CASE WHEN size(__win) = size(array_distinct(__win)) THEN 0L ELSE
  aggregate(
    sort_array(
      transform(
        array(sort_array(transform(__win, (h, i) -> named_struct('h', h, 'i', i)))),
        s -> transform(
          filter(sequence(0, size(s) - 1),
                 k -> get(s, k).h = get(s, k - 1).h OR get(s, k).h = get(s, k + 1).h),
          k -> get(s, k).i))[0]),
    named_struct('n', 0L, 'at', -3),
    (a, p) -> named_struct('n', a.n + least(3, p - a.at), 'at', p),
    a -> a.n)
END"""


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with METRICS; no shuffle, one pass over the text."""
    out = df.drop(*METRICS)
    out = out.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumn("__trim", F.expr(f"btrim(__text, '{_SPACE}')"))
    out = out.withColumn(
        "__words", F.expr("CASE WHEN __trim = '' THEN cast(array() AS array<string>) ELSE split(__trim, '[ \\\\t-\\\\r]+') END")
    )
    out = out.withColumn("__lines", F.expr("filter(split(__text, '\\n'), x -> btrim(x, '%s') <> '')" % _SPACE))
    out = out.withColumn(
        "__win",
        F.expr(
            "CASE WHEN size(__words) < 3 THEN cast(array() AS array<bigint>) ELSE "
            "transform(sequence(0, size(__words) - 3), i -> xxhash64(get(__words, i), get(__words, i + 1), get(__words, i + 2))) END"
        ),
    )
    out = (
        out.withColumn("n_words", F.size("__words").cast("long"))
        .withColumn("word_chars", F.char_length(F.array_join("__words", "")).cast("long"))
        .withColumn("n_symbols", F.expr("(char_length(__text) - char_length(translate(__text, '#*$%&|<>', '')))").cast("long"))
        .withColumn("n_dup_lines", F.expr("size(__lines) - size(array_distinct(__lines))").cast("long"))
        .withColumn("n_repeat_words", F.expr(_REPEATS).cast("long"))
    )
    return out.withColumn(
        "base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
    ).drop("__text", "__trim", "__words", "__lines", "__win")


def host_rates(measured: DataFrame, host_col: str) -> DataFrame:
    """Per host: rows, failures and the shrunk failure rate.

    The prior is one row of sums over the hosts, so nothing that grows with
    the number of hosts reaches the driver.
    """
    hosts = materialize(
        measured.where(F.col(host_col).isNotNull())
        .groupBy(F.col(host_col).alias("__host"))
        .agg(F.count("*").alias("host_rows"), F.sum(F.col("base_failed").cast("long")).alias("host_failed")),
        "hosts",
    )
    total = hosts.agg(
        F.sum("host_rows").alias("n"),
        F.sum("host_failed").alias("f"),
        F.count("*").alias("hosts"),
        F.sum(F.col("host_failed") * F.col("host_failed") / F.col("host_rows")).alias("ff"),
    ).first()
    alpha, beta = beta_prior(total["n"] or 0, total["f"] or 0, total["hosts"], total["ff"] or 0.0)
    rate = (F.col("host_failed") + F.lit(alpha)) / (F.col("host_rows") + F.lit(alpha + beta))
    return hosts.withColumn("host_rate", rate)


def beta_prior(rows: int, failed: int, hosts: int, squares: float) -> tuple[float, float]:
    """Moments of the host rates, the binomial part of their spread removed.

    squares: sum over hosts of failures squared over rows.
    """
    if not rows:
        return 0.5, 0.5
    mean = failed / rows
    inside = mean * (1 - mean)
    between = squares / rows - mean * mean - inside * hosts / rows
    strength = inside / between - 1 if between > 0 else PRIOR_ROWS[1]
    strength = min(max(strength, PRIOR_ROWS[0]), PRIOR_ROWS[1])
    return mean * strength, (1 - mean) * strength


def assess(
    df: DataFrame, *, text_col: str = "text", host_col: str = "source", columns: list[str] | None = None, max_host_rate: float = MAX_HOST_RATE
) -> DataFrame:
    """The rows with METRICS and ``kept``; ``columns`` are those of the input to carry (default: all).

    The measured rows are written once; the host verdicts come from that table
    and meet it again in a checked broadcast or a shuffled join.
    """
    columns = [c for c in (columns or df.columns) if c not in (*METRICS, "kept")]
    measured = measure(df.drop("kept"), text_col).withColumn("__host", F.col(host_col).cast("string"))
    rows = materialize(measured.select(*columns, *METRICS, "__host"), "measured")
    rejected = host_rates(rows, "__host").where(F.col("host_rate") > max_host_rate)
    verdicts = materialize(rejected.select("__host", F.lit(True).alias("__rejected")), "verdicts")
    out = join_lookup(rows, verdicts, "__host")
    kept = ~F.col("base_failed") & F.col("__rejected").isNull()
    return out.select(*columns, *METRICS, kept.alias("kept"))


def filter_documents(df: DataFrame, *, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows that pass, with the input's own columns."""
    return assess(df.withColumnsRenamed({c: f"__in_{c}" for c in df.columns}), text_col=f"__in_{text_col}", host_col=f"__in_{host_col}").where("kept").select(*[F.col(f"__in_{c}").alias(c) for c in df.columns])


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return assess(docs, columns=["doc_id"]).select("doc_id", *METRICS, "kept")


OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (
  SELECT doc_id, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
pos AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3),
win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS times FROM pos),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win WHERE times > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, d.source,
         CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (
  SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM m),
h AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(sum(base_failed::INT) AS DOUBLE) AS f
  FROM b WHERE source IS NOT NULL GROUP BY source),
s AS (
  SELECT sum(f) / sum(n) AS mean, count(*) / sum(n) AS per_row, sum(f * f / n) / sum(n) AS sq FROM h),
v AS (SELECT mean, mean * (1 - mean) AS inside, sq - mean * mean - mean * (1 - mean) * per_row AS between_hosts FROM s),
p AS (
  SELECT mean, least(greatest(CASE WHEN between_hosts > 0 THEN inside / between_hosts - 1 ELSE {PRIOR_ROWS[1]} END, {PRIOR_ROWS[0]}), {PRIOR_ROWS[1]}) AS strength FROM v),
bad AS (
  SELECT h.source FROM h, p WHERE (h.f + mean * strength) / (h.n + strength) > {MAX_HOST_RATE})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND bad.source IS NULL) AS kept
FROM b LEFT JOIN bad ON b.source = bad.source
"""
