"""Sources and sinks: page addresses, stored API answers, pasted texts, folders of results, reports."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textspan.functions import text
from textspan.sources.stored import stored

HOST = "wikipedia.org"


def page_request(url: Column) -> Column:
    """struct(status, title, lang, error) of an article's address."""
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    parts = F.split(host, r"\.")
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    title = F.replace(F.try_url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B"))), F.lit("_"), F.lit(" "))
    known = (F.size(parts) >= 3) & host.endswith("." + HOST)
    error = F.when(~known, f"URL must be from a {HOST} domain").when(F.coalesce(title, F.lit("")) == "", "Could not find a page title in the URL").otherwise("")
    return F.struct(
        F.when(error == "", "ok").otherwise("error").alias("status"), F.when(error == "", title).alias("title"), F.when(error == "", F.get(parts, F.lit(0))).alias("lang"), error.alias("error")
    )


def answered_html(payload: Column) -> Column:
    """struct(status, html, error) of a stored answer to a request for a rendered page."""
    failed = F.get_json_object(payload, "$.error.info")
    html = F.get_json_object(payload, "$.parse.text")
    error = F.when(F.get_json_object(payload, "$.error").isNotNull(), F.coalesce(failed, F.lit("Unknown API error"))).when(html.isNull(), "no page in the answer").otherwise("")
    return F.struct(F.when(error == "", "ok").otherwise("error").alias("status"), html.alias("html"), error.alias("error"))


def answered_extract(payload: Column) -> Column:
    """struct(status, text, error) of a stored answer to a request for an extract."""
    failed = F.get_json_object(payload, "$.error")
    page = F.get_json_object(payload, "$.query.pages[0]")
    gone = F.coalesce(F.get_json_object(payload, "$.query.pages[0].missing") == "true", F.lit(False))
    error = F.when(failed.isNotNull(), F.coalesce(F.get_json_object(payload, "$.error.info"), F.lit("Unknown API error"))).when(page.isNull() | gone, "page not found").otherwise("")
    return F.struct(F.when(error == "", "ok").otherwise("error").alias("status"), F.coalesce(F.get_json_object(payload, "$.query.pages[0].extract"), F.lit("")).alias("text"), error.alias("error"))


def request_url(title: Column, lang: Column, kind: str) -> Column:
    """The address of the API request for a page; asking is left to whoever stores the answers."""
    query = "action=parse&prop=text&format=json&formatversion=2&redirects=1&page=" if kind == "html" else "action=query&prop=extracts&explaintext=1&format=json&formatversion=2&redirects=1&titles="
    return F.concat(F.lit("https://"), lang, F.lit(f".{HOST}/w/api.php?{query}"), F.replace(F.url_encode(title), F.lit("+"), F.lit("%20")))


def pasted(spark: SparkSession, path: str) -> DataFrame:
    """(path, copied) of pasted texts, one file each; blank ones are left out."""
    found = spark.read.format("text").option("wholetext", "true").load(path)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("copied")).where(text.squeeze_ends(F.col("copied")) != "")


def write_texts(results: DataFrame, folder: str) -> None:
    """(title, lang, text) below folder/topic=/language=, as the results' own folders are named."""
    named = results.select(text.safe_name(F.col("title")).alias("topic"), text.language_folder(F.col("lang")).alias("language"), "text")
    named.write.mode("overwrite").partitionBy("topic", "language").parquet(folder)


def write_files(results: DataFrame) -> DataFrame:
    """Write (path, text), one text file each, where the paths say: (path, chars) of the files. Tasks write
    through Arrow's file systems; a file gets its name when it is complete, so a task that runs again
    leaves the same. Null text writes no file. Of rows with equal paths one wins."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        for batch in batches:
            done: list[tuple[str, int]] = []
            for at, body in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if at is None or body is None:
                    continue
                store, place = fs.FileSystem.from_uri(at if ":" in at.split("/")[0] else f"file://{os.path.abspath(at)}")
                above, _, name = place.rpartition("/")
                store.create_dir(above, recursive=True)
                draft = f"{above}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(body.encode("utf-8", "surrogatepass"))
                store.move(draft, place)
                done.append((at, len(body)))
            yield pa.RecordBatch.from_pydict({"path": pa.array([d[0] for d in done], pa.string()), "chars": pa.array([d[1] for d in done], pa.int64())})

    return stored(results.select("path", "text").mapInArrow(work, "path string, chars long"), "files")


def clear_method_files(spark: SparkSession, folder: str) -> int:
    """Delete the method texts of an earlier comparison in a folder; how many there were."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/partial_benchmark_*_text.txt")
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in store.globStatus(at) or []]
    for path in found:
        store.delete(path, False)
    return len(found)


def append_comparison(rows: DataFrame, folder: str) -> None:
    """Append comparison rows as CSV; a folder with another header is written anew."""
    spark = rows.sparkSession
    try:
        same = spark.read.option("header", "true").csv(folder).columns == rows.columns
    except Exception as e:  # no such folder yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        same = False
    rows.write.mode("append" if same else "overwrite").option("header", "true").csv(folder)


def merged_runtimes(entries: DataFrame, key: str = "page") -> DataFrame:
    """(key, label, seconds, place): the last entry (greatest seq) of each label, in report order."""
    last = Window.partitionBy(key, "label").orderBy(F.desc("seq"))
    now = entries.withColumn("r", F.row_number().over(last)).where("r = 1").drop("r", "seq")
    order = Window.partitionBy(key).orderBy(text.label_order(F.col("label")), "label")
    return now.withColumn("place", F.row_number().over(order))


def comparison(left: Column, right: Column) -> Column:
    """Sizes of two cleanings of a page and how far they are apart."""
    a, b = F.size(text.lines(left)), F.size(text.lines(right))
    return F.struct(
        F.length(left).alias("left_chars"), F.length(right).alias("right_chars"), F.abs(F.length(left) - F.length(right)).alias("char_mismatch"),
        a.alias("left_lines"), b.alias("right_lines"), F.abs(a - b).alias("line_mismatch"), (left == right).alias("exact"),
    )
