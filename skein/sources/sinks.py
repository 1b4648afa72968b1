"""Writers. Small report files are written by the driver, tables by the cluster."""

from __future__ import annotations

import csv
import io
import json
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, overwrite: bool = False) -> None:
    """A Parquet table; an existing one is an error unless overwrite is set."""
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def csv_table(df: DataFrame, path: str) -> None:
    """CSV with every field quoted, by the cluster."""
    df.write.mode("errorifexists").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def id_list(df: DataFrame, key: str, path: str, header: Iterable[str] = ()) -> int:
    """Sorted distinct ids, one per line, under # comment lines; returns their number."""
    _refuse(path)
    n = 0
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        f.writelines(f"# {line}\n" for line in header)
        for (v,) in df.select(F.col(key).cast("string")).where(F.col(key).isNotNull()).distinct().orderBy(key).toLocalIterator():
            f.write(f"{v}\n")
            n += 1
    return n


def _refuse(path: str) -> None:
    if os.path.exists(path):
        raise FileExistsError(f"{path} exists and is not overwritten")


def report_csv(rows: list[dict], columns: list[str]) -> bytes:
    """Byte-order mark, all fields quoted, CRLF: the form spreadsheets take."""
    out = io.StringIO()
    w = csv.DictWriter(out, columns, quoting=csv.QUOTE_ALL, lineterminator="\r\n")
    w.writeheader()
    w.writerows(rows)
    return b"\xef\xbb\xbf" + out.getvalue().encode()


def report_json(value: object, path: str) -> None:
    """A statistics document with sorted keys; times as ISO text."""
    _refuse(path)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True, ensure_ascii=False, default=lambda x: x.isoformat() if hasattr(x, "isoformat") else float(x))
        f.write("\n")


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A small metric table as Markdown; null is a dash, numbers have up to four decimals."""
    def show(v: object) -> str:
        if v is None:
            return "–"
        if isinstance(v, bool):
            return "yes" if v else "no"
        return f"{v:.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")

    rows = df.limit(limit).collect()
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(show, r)) + " |" for r in rows)])
