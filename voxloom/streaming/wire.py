"""What goes over the wire: server-sent events and frames without null fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def sse(event: Column, payload: Column) -> Column:
    """One server-sent event: its name and one line of JSON of the struct ``payload``; null fields are left out."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(payload), F.lit("\n\n"))


def to_wire(frame: Column) -> Column:
    """A struct as JSON without its null fields."""
    return F.to_json(frame, {"ignoreNullFields": "true"})


def speech_events(chunks: DataFrame, request: str, order: str, pcm: str, rate: int) -> DataFrame:
    """Rows (request, seq, event) of 16-bit chunks (request, order, pcm binary): one ``chunk`` each, then one ``done``.

    ``done`` tells the chunks, samples and seconds; a request of which a chunk is null ends in one ``error`` instead.
    """
    w = Window.partitionBy(request).orderBy(order)
    seq = F.row_number().over(w) - 1
    failed = F.max(F.col(pcm).isNull()).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = chunks.withColumn("seq", seq).withColumn("failed", failed)
    each = rows.where("not failed").select(request, "seq", sse(F.lit("chunk"), F.struct(F.col("seq").alias("index"), F.base64(pcm).alias("audio"))).alias("event"))
    totals = rows.groupBy(request).agg(
        F.count_if(~F.col("failed")).alias("chunks"), F.coalesce(F.sum(F.when(~F.col("failed"), F.octet_length(pcm) / 2)), F.lit(0)).cast("long").alias("samples"), F.max("failed").alias("failed")
    )
    done = sse(F.lit("done"), F.struct("chunks", "samples", (F.col("samples") / F.lit(float(rate))).alias("duration")))
    end = F.when(F.col("failed"), sse(F.lit("error"), F.struct(F.lit("generation failed").alias("message")))).otherwise(done)
    return each.unionByName(totals.select(request, F.col("chunks").cast("int").alias("seq"), end.alias("event")))
