"""Language identification by Bayesian fusion of evidence.

The posterior of a language multiplies: the likelihood of the text's bytes
under a trigram model; the likelihood of the declared markup language and of the
address suffix given the language; and a prior of the host that is smoothed
towards its domain's, which is smoothed towards that of all rows. Priors and
the two likelihood tables are counts of the whole input, gathered by grouped
aggregation over what the text alone says.

The trigram models are fitted on labelled rows: about SAMPLE_ROWS texts of each
language (all, if it has no more), those of the smallest hashes, equal ones
once, whatever the size of the input. A label trains and is no evidence. A label's language is its first part, of two to eight letters
(pt-BR is pt, gsw stays gsw); every labelled language has a model. One further
model, of single bytes, stands for "no known language".

Defined results: a null or empty text, or one without any letter, has no
language and isn't kept; null or unknown declared languages, addresses and
hosts add no evidence; without labelled rows no language is known, ``language``
is null and all rows are kept; ties go to the language first in the alphabet;
texts are read whole; rows repeat as often as they come; input columns named
like an output are replaced.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_lookup, map_batches, materialize

#: Labelled rows of each language that its model is fitted on, about.
SAMPLE_ROWS = 4000
#: Rows that a domain's prior counts for at a host, and all rows' prior at a domain.
PRIOR_ROWS = 20.0
#: Overlapping trigrams say the same thing about three times.
OVERLAP = 3.0
#: Prior probability that a text is in no known language, and the posterior a kept row needs.
NO_LANGUAGE, MIN_POSTERIOR = 0.01, 0.5

CLASSES = 64


@functools.lru_cache(1)
def byte_classes() -> np.ndarray:
    """Each byte's class, below CLASSES: letters apart, signs together, UTF-8 bytes folded."""
    table = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b).lower()
        if b < 128 and c.isalpha():
            table[b] = ord(c) - ord("a") + 1
        elif b < 128:
            table[b] = 0 if c.isspace() or b < 32 else 27 if c.isdigit() else 28 if c in ".,;:!?" else 29 if c == "'" else 30
        elif b < 0xC0:
            table[b] = 31 + b % 22
        else:
            table[b] = 53 + b % 11
    return table


def trigrams(text: str) -> np.ndarray:
    """Codes of the byte-class trigrams of a whole text, a blank at either end; runs of signs stay as they are."""
    c = byte_classes()[np.frombuffer(b" " + text.encode() + b" ", np.uint8)]
    return (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]


class Model:
    """Log-likelihoods of the third byte class given two, for each language and for none.

    counts: (codes, numbers) of the trigrams seen, for each language. The table
    has a row for each trigram that any language has seen; others take the row
    of their first two classes and the third's own share.
    """

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.languages, n = languages, len(languages)
        seen = np.unique(np.concatenate([codes for codes, _ in counts]))
        single, pair = np.ones(CLASSES), np.zeros((n, CLASSES * CLASSES))
        for i, (codes, numbers) in enumerate(counts):
            single += np.bincount(codes % CLASSES, numbers, CLASSES)
            pair[i] = np.bincount(codes // CLASSES, numbers, CLASSES * CLASSES)
        single /= single.sum()
        none = np.log(0.5 * single + 0.5 / CLASSES)
        self.seen, self.thirds = len(seen), np.stack([np.log(single), none])
        self.row = (len(seen) + np.arange(CLASSES**3) // CLASSES).astype(np.int32)
        self.row[seen] = np.arange(len(seen))
        self.table = np.zeros((len(seen) + CLASSES * CLASSES, n + 1), np.float32)
        self.table[: len(seen), n] = none[seen % CLASSES]
        for i, (codes, numbers) in enumerate(counts):
            own = 8.0 * single[seen % CLASSES]
            own[np.searchsorted(seen, codes)] += numbers
            self.table[: len(seen), i] = np.log(own / (pair[i, seen // CLASSES] + 8.0))
            self.table[len(seen) :, i] = np.log(8.0 / (pair[i] + 8.0))

    def score(self, text: str | None) -> np.ndarray | None:
        """Log-likelihoods, the overlap taken out; None where there is no letter."""
        if not text or not any(map(str.isalpha, text)):
            return None
        codes, total = trigrams(text), np.zeros(self.table.shape[1])
        step = max((1 << 22) // len(total), 1)
        for at in range(0, len(codes), step):
            part = codes[at : at + step]
            rows = self.row[part]
            total += self.table[rows].sum(0, dtype=np.float64)
            language, none = self.thirds[:, part[rows >= self.seen] % CLASSES].sum(1)
            total[:-1] += language
            total[-1] += none
        return total / OVERLAP


def code_of(label: Column) -> Column:
    """The language of a label or declaration: its first part, of two to eight letters; null if it has none."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]{2,8})(?=[-_]|$)", 1), F.lit(""))


def sample(rows: DataFrame, sample_rows: int) -> DataFrame:
    """Of rows (text, label, h) about ``sample_rows`` of each label by the hash h of the text, never none; equal texts count once."""
    share = F.lit(float(sample_rows)) / F.count("*")
    bound = F.when(share >= 1, F.lit((1 << 63) - 1)).otherwise((share * 2.0**64 - 2.0**63).cast("long"))
    bounds = materialize(rows.groupBy("label").agg(F.greatest(bound, F.min("h")).alias("bound")), "bounds")
    return join_lookup(rows, bounds, "label").where("h <= bound").dropDuplicates(["label", "h"])


def fit(df: DataFrame, *, text_col: str, label_col: str, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model of each label of a sample that is bounded for each; only summed counts reach the driver."""
    rows = df.select(F.col(text_col).alias("text"), code_of(F.col(label_col)).alias("label"), F.xxhash64(text_col).alias("h"))
    rows = sample(rows.where("text IS NOT NULL AND label IS NOT NULL"), sample_rows)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes, numbers = np.unique(trigrams(text), return_counts=True)
                own = sums.get(label)
                if own is None:
                    own = sums[label] = np.zeros(CLASSES**3, np.int32)
                own[codes] += numbers.astype(np.int32)
        for label, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at)), pa.array(at.astype(np.int32)), pa.array(own[at].astype(np.int64))], names=["label", "code", "n"])

    parts = rows.select("text", "label").mapInArrow(count, "label string, code int, n long")
    found = parts.groupBy("label", "code").agg(F.sum("n").alias("n")).toArrow().combine_chunks().sort_by([("label", "ascending"), ("code", "ascending")])
    codes, numbers = (found[c].to_numpy() for c in ("code", "n"))
    labels = found["label"].value_counts().to_pylist() if found.num_rows else []
    names = [x["values"] for x in labels]  # in order, as the rows are
    ends = np.cumsum([0, *(x["counts"] for x in labels)])
    return Model(names, [(codes[a:b], numbers[a:b]) for a, b in zip(ends, ends[1:])]) if names else None


def declared_in(markup: Column) -> Column:
    """The language that a page's html element declares."""
    return F.lower(F.nullif(F.regexp_extract(markup, r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([a-z]{2,8})(?![a-z0-9])", 1), F.lit("")))


def host_of(address: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(address, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def domain_of(host: Column) -> Column:
    """The last two labels of a host name; null where there is no dot."""
    return F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit(""))


def suffix_of(address: Column) -> Column:
    """Two letters of an address or a bare host name: the first step of the path if it has two, else the top-level domain if it has."""
    path = F.regexp_extract(address, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]+/([a-z]{2})(?:[/?#]|$)", 1)
    host = F.coalesce(host_of(address), F.lower(address))
    return F.lower(F.coalesce(F.nullif(path, F.lit("")), F.nullif(F.regexp_extract(host, r"^[^/?#\s]*\.([a-z]{2})$", 1), F.lit(""))))


def counted(rows: DataFrame, column: str, number: str = "n") -> DataFrame:
    """A row for each value of the column: how many rows each language has in it, as a map of those that have any, and all together."""
    known = rows.where(F.col(column).isNotNull() & F.col("text_best").isNotNull())
    parts = known.groupBy(column, "text_best").agg(F.sum(number).alias("n"))
    return parts.groupBy(column).agg(F.map_from_entries(F.collect_list(F.struct("text_best", "n"))).alias("counts"), F.sum("n").alias("total"))


def by_language(n: int, value) -> Column:
    """An array with value(language number) for each language."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), value)


def count_of(counts: Column, i: Column) -> Column:
    return F.coalesce(F.try_element_at(counts, i), F.lit(0)).cast("double")


def evidence_table(scored: DataFrame, column: str, n: int) -> DataFrame:
    """Materialized: the column and log P(value | language), one count added to each; no language gets the mean of its row."""
    ones = scored.withColumn("n", F.lit(1))
    known = materialize(counted(ones, column), "evidence")
    values = known.count()
    each = {r["i"]: r["n"] for r in known.select(F.explode("counts").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("n")).collect()}
    sums = F.array(*[F.lit(float(each.get(i, 0) + values)) for i in range(n)])
    logs = by_language(n, lambda i: F.log((count_of(F.col("counts"), i) + 1.0) / F.get(sums, i)))
    mean = F.aggregate("logs", F.lit(0.0), lambda a, x: a + x) / n
    return materialize(known.select(column, logs.alias("logs")).select(column, F.concat("logs", F.array(mean)).alias(f"{column}_logs")), "evidence-logs")


def host_priors(scored: DataFrame, n: int) -> DataFrame:
    """Materialized: __host and its log prior of each language, smoothed by domain and by all rows."""
    hosts = materialize(counted(scored.withColumn("n", F.lit(1)), "__host").withColumn("__domain", domain_of(F.col("__host"))), "hosts")
    parts = hosts.select("__domain", F.explode("counts").alias("text_best", "n"))
    each = {r["text_best"]: r["n"] for r in parts.groupBy("text_best").agg(F.sum("n").alias("n")).collect()}
    counts = [each.get(i, 0) + 1.0 for i in range(n)]
    overall = F.array(*[F.lit(c / sum(counts)) for c in counts])
    domains = counted(parts, "__domain").select("__domain", F.col("counts").alias("in_domain"), F.col("total").alias("all_domain"))
    both = join_lookup(hosts, materialize(domains, "domains"), "__domain")

    def prior(i):
        domain = (count_of(F.col("in_domain"), i) + PRIOR_ROWS * F.get(overall, i)) / (F.coalesce("all_domain", F.lit(0)) + PRIOR_ROWS)
        return F.log((count_of(F.col("counts"), i) + PRIOR_ROWS * domain) / (F.col("total") + PRIOR_ROWS))

    return materialize(both.select("__host", by_language(n, prior).alias("prior")), "priors")


def identify(
    df: DataFrame,
    *,
    text_col: str = "text",
    label_col: str | None = "lang",
    declared: Column | None = None,
    address: Column | None = None,
    host: Column | None = None,
    columns: list[str] | None = None,
    model: Model | None = None,
    min_posterior: float = MIN_POSTERIOR,
) -> DataFrame:
    """``columns`` of the input (default: all) with language, posterior and kept.

    Texts are scored in one pass and written once; priors and tables come from
    that table; the host's prior meets its rows in a checked broadcast or a
    shuffled join.
    """
    outputs = ("language", "posterior", "kept")
    columns = [c for c in (columns or df.columns) if c not in outputs]
    if model is None and label_col:
        model = fit(df, text_col=text_col, label_col=label_col)
    if model is None:
        return df.select(*columns, F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("posterior"), F.lit(True).alias("kept"))
    n = len(model.languages)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(arrays):
        rows = [shared.value.score(t) for t in arrays[0].to_pylist()]
        best = [None if r is None or r.argmax() == n else int(r.argmax()) for r in rows]
        return [pa.array([None if r is None else r.tolist() for r in rows], pa.list_(pa.float64())), pa.array(best, pa.int32())]

    none = F.lit(None).cast("string")
    address = none if address is None else address
    host = host_of(address) if host is None else host
    ready = df.withColumns({"__host": host.cast("string"), "__declared": code_of(none if declared is None else declared), "__suffix": suffix_of(address)})
    scored = materialize(map_batches(ready, [*columns, "__host", "__declared", "__suffix"], [F.col(text_col)], score, {"scores": "array<double>", "text_best": "int"}), "scored")
    rows = join_lookup(scored, host_priors(scored, n), "__host")
    for column in ("__declared", "__suffix"):
        rows = join_lookup(rows, evidence_table(scored, column, n), column)
    flat, nothing = F.array_repeat(F.lit(-math.log(n)), n), F.array_repeat(F.lit(0.0), n + 1)
    prior = F.concat(F.transform(F.coalesce("prior", flat), lambda p: p + math.log(1 - NO_LANGUAGE)), F.array(F.lit(math.log(NO_LANGUAGE))))
    logs = functools.reduce(
        lambda a, b: F.zip_with(a, b, lambda x, y: x + y),
        [F.col("scores"), prior, *[F.coalesce(f"{c}_logs", nothing) for c in ("__declared", "__suffix")]],
    )
    rows = rows.withColumn("__logs", logs).withColumn("__top", F.array_max("__logs"))
    rows = rows.withColumn("__sum", F.aggregate("__logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("__top"))))
    rows = rows.withColumn("__at", F.array_position("__logs", F.col("__top")).cast("int"))
    names = F.array(*[F.lit(x) for x in model.languages])
    language = F.get(names, F.col("__at") - 1)
    posterior = 1.0 / F.col("__sum")
    kept = F.coalesce(language.isNotNull() & (posterior >= min_posterior), F.lit(False))
    return rows.select(*columns, language.alias("language"), posterior.alias("posterior"), kept.alias("kept"))


def of_documents(df: DataFrame, *, text_col: str, label_col: str, host_col: str, columns: list[str]) -> DataFrame:
    """Documents by their text, the language that markup in it declares, and their source as address and host; labels only train."""
    return identify(df, text_col=text_col, label_col=label_col, declared=declared_in(F.col(text_col)), address=F.col(host_col), host=F.coalesce(host_of(F.col(host_col)), F.lower(host_col)), columns=columns)


def filter_documents(df: DataFrame, *, text_col: str = "text", label_col: str = "lang", host_col: str = "source") -> DataFrame:
    """The rows in a known language, with the input's own columns."""
    own = df.withColumnsRenamed({c: f"__in_{c}" for c in df.columns})
    found = of_documents(own, text_col=f"__in_{text_col}", label_col=f"__in_{label_col}", host_col=f"__in_{host_col}", columns=own.columns)
    return found.where("kept").select(*[F.col(f"__in_{c}").alias(c) for c in df.columns])


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """All documents; ``lang`` labels the sample that the models are fitted on and is no evidence."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    found = of_documents(docs, text_col="text", label_col="lang", host_col="source", columns=["doc_id"])
    return found.select("doc_id", "language", F.round("posterior", 6).alias("posterior"), "kept")


def pages_language(spark, sf_dir: str) -> DataFrame:
    """All pages: text and declared language of the markup, address suffix, host and domain; models from documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    model = fit(docs, text_col="text", label_col="lang")
    from tessera.llm.html_extract import extract_text

    texts = extract_text(pages.withColumn("declared", declared_in(F.col("html"))))
    found = identify(texts, label_col=None, model=model, declared=F.col("declared"), address=F.col("url"), columns=["page_id"])
    return found.select("page_id", "language", F.round("posterior", 6).alias("posterior"), "kept")
