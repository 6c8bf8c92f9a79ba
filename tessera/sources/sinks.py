"""Sinks of results: TSV, JSON lines, one JSON document, pandas, callbacks."""

from __future__ import annotations

import csv
import itertools
import json
import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tessera.control import Progress, ticking
from tessera.operators.export import flatten
from tessera.schemas import RESULT_COLUMNS


def _ordered(df: DataFrame) -> DataFrame:
    return df.orderBy("ord") if "ord" in df.columns else df


def _tsv_rows(results: DataFrame) -> DataFrame:
    """Flat rows as texts: True and False, and an empty field without a score."""
    flat = flatten(_ordered(results))
    return flat.withColumns({"resolved": F.initcap(F.col("resolved").cast("string")), "confidence_score": F.coalesce(F.col("confidence_score").cast("string"), F.lit(""))})


def write_tsv(results: DataFrame, path: str, *, single_file: bool = False) -> None:
    """Flat rows with a header. A folder of part files wherever Spark can write; single_file: one file on the driver's disk, row by row as partitions come in."""
    rows = _tsv_rows(results)
    if not single_file:
        rows.write.mode("overwrite").options(sep="\t", header=True, emptyValue="", nullValue="", quote='"', escape='"').csv(path)
        return
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f, delimiter="\t", lineterminator="\n")
        out.writerow(rows.columns)
        for row in rows.toLocalIterator(prefetchPartitions=True):
            out.writerow(["" if x is None else x for x in row])


def write_json_lines(results: DataFrame, path: str) -> None:
    """One JSON object a line with all fields but the raw response, nulls included; any size."""
    columns = [c for c in results.columns if c != "raw_response"]
    results.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def save_results(results: DataFrame, summary: dict | None = None, *, json_path: str | None = None, tsv_path: str | None = None) -> None:
    """One JSON document {"summary", "mappings"} and/or one TSV file on a local disk.

    The document is written row by row as the driver fetches partitions, so it
    never holds more than one of them.
    """
    if json_path is not None:
        os.makedirs(os.path.dirname(os.path.abspath(json_path)), exist_ok=True)
        columns = [c for c in RESULT_COLUMNS if c != "raw_response"]
        rows = _ordered(results).select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))
        with open(json_path, "w", encoding="utf-8") as f:
            f.write('{\n  "summary": ' + json.dumps(summary, indent=2, default=str).replace("\n", "\n  ") + ',\n  "mappings": [')
            mark = "\n"
            for row in rows.toLocalIterator(prefetchPartitions=True):
                f.write(mark + "    " + json.dumps(json.loads(row["json"]), indent=2).replace("\n", "\n    "))
                mark = ",\n"
            f.write("\n  ]\n}\n")
    if tsv_path is not None:
        write_tsv(results, tsv_path, single_file=True)


#: Rows of a frame where results are fetched in several.
FRAME_ROWS = 20_000


def results_to_frames(results: DataFrame, *, rows: int = FRAME_ROWS) -> Iterator:
    """The flat rows as pandas frames of at most ``rows`` rows, in order and numbered through; the driver holds a partition and a frame."""
    try:
        import pandas
    except ImportError as e:
        raise ImportError("pandas is needed to fetch results as a pandas frame") from e
    flat, at = flatten(_ordered(results)), 0
    walk = flat.toLocalIterator()
    while part := [tuple(row) for row in itertools.islice(walk, rows)]:
        index = pandas.RangeIndex(at, at + len(part))
        yield pandas.DataFrame.from_records(part, columns=flat.columns, index=index).astype({"confidence_score": "float64"})
        at += len(part)


def results_to_pandas(results: DataFrame):
    """The flat rows as one pandas frame, in order; it has to fit the driver, else ``results_to_frames``."""
    parts = list(results_to_frames(results))
    if not parts:
        return flatten(results).limit(0).toPandas()
    import pandas

    return pandas.concat(parts)


def for_each_result(results: DataFrame, on_result: Callable[[Row], None], *, progress: Progress = False, total_hint: int | None = None) -> int:
    """Calls back for each result in order, on the driver; what the callback raises ends the walk."""
    n = 0
    with ticking(progress, total_hint, "Mapping") as tick:
        for row in _ordered(results).toLocalIterator():
            n += 1
            tick(1)
            on_result(row)
    return n
