"""Sinks for forecasts, result tables, documents and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def forecast(df: DataFrame, path: str) -> None:
    """Parquet by lead, the column that readers filter on; p at rest in single precision."""
    df.withColumn("p", F.col("p").cast("float")).write.mode("overwrite").partitionBy("k").parquet(path)


def table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def documents(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def log_line(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("append").text(path)


def jdbc(df: DataFrame, url: str, name: str, batch: int = 20_000, **properties: str) -> None:
    df.write.mode("append").option("batchsize", batch).jdbc(url, name, properties=properties)


def in_batches(df: DataFrame, send: Callable[[list[dict]], None], size: int = 20_000) -> None:
    """Hands the rows to ``send`` as lists of dictionaries, from every partition by itself, as bulk
    statements of a graph store want them. send has to bear being handed rows twice: a task that fails
    is repeated."""

    def run(rows: Iterable[Row]) -> None:
        held: list[dict] = []
        for r in rows:
            held.append(r.asDict(recursive=True))
            if len(held) == size:
                send(held)
                held = []
        if held:
            send(held)

    df.foreachPartition(run)


def _cells(df: DataFrame, digits: int, most: int) -> list[list[str]]:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    return [[f"{v:+.{digits}f}" if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in rows]


def markdown(df: DataFrame, digits: int = 2, most: int = 500) -> str:
    """A small table for a report."""
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(r) + " |" for r in _cells(df, digits, most)])


def latex(df: DataFrame, digits: int = 2, most: int = 500) -> str:
    body = [" & ".join(x.replace("_", r"\_").replace("%", r"\%").replace("&", r"\&") for x in r) + r" \\" for r in _cells(df, digits, most)]
    head = " & ".join(c.replace("_", r"\_") for c in df.columns) + r" \\ \hline"
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", head, *body, r"\end{tabular}"])
