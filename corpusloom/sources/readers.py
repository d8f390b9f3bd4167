"""Readers of document files, and of the stores that the operators keep."""

from __future__ import annotations

import html
import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: suffixes that are read.
SUFFIXES = ("txt", "md", "fountain", "docx", "doc", "wps", "pdf")
CJK = re.compile("[一-鿿]")
#: Fixed value: a run of wide text, ten characters at least.
WIDE_RUN = re.compile(r"[\u4e00-\u9fff][\u4e00-\u9fff0-9A-Za-z，。！？：；“”‘’、…—·:;,.!?()\[\]（）【】《》\"'\s-]{9,}")
#: What a damaged, cut or locked archive raises.
DAMAGED = (zipfile.BadZipFile, KeyError, RuntimeError, zlib.error, EOFError, OSError, NotImplementedError)


def decoded(data: bytes) -> str:
    """UTF-8, then GBK, then UTF-8 without what can't be read."""
    for name in ("utf-8", "gbk"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "ignore")


def decoded_wide(data: bytes) -> str:
    """GB 18030, UTF-8, UTF-16, then GB 18030 with replacement."""
    for name in ("gb18030", "utf-8", "utf-16"):
        try:
            return data.decode(name)
        except UnicodeError:
            continue
    return data.decode("gb18030", "replace")


def decoded_best(data: bytes) -> str:
    """Of UTF-8 and GBK the one with the larger share of CJK characters; UTF-8 on a tie."""

    def share(t: str) -> float:
        z = "".join(t.split())
        return len(CJK.findall(z)) / len(z) if z else 0.0

    a, b = data.decode("utf-8", "ignore"), data.decode("gbk", "ignore")
    return b if share(b) > share(a) else a


def docx_text(data: bytes) -> str | None:
    """Text runs of each paragraph, a line each; paragraphs without runs are left out; no zip gives None."""
    try:
        xml = zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml").decode("utf-8", "ignore")
    except DAMAGED:
        return None
    found = (re.findall(r"<w:t(?:\s[^>]*)?>(.*?)</w:t>", p, re.DOTALL) for p in re.findall(r"<w:p[ >].*?</w:p>", xml, re.DOTALL))
    return "\n".join("".join(runs) for runs in found if runs) or None


def docx_flat(data: bytes) -> str | None:
    """Every paragraph end a line break, all tags gone, entities resolved."""
    try:
        xml = zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml").decode("utf-8", "ignore")
    except DAMAGED:
        return None
    return html.unescape(re.sub(r"<[^>]+>", "", xml.replace("</w:p>", "\n")))


def doc_text(data: bytes) -> str | None:
    """Runs of wide text in an old binary document, their ends trimmed; GBK where that finds more; None without any."""

    def runs(text: str) -> str:
        return "\n".join(r.strip() for r in WIDE_RUN.findall(text))

    text = runs(data.decode("utf-16-le", "ignore"))
    if 2 * len(text) < len(data) / 100:
        other = data.decode("gbk", "ignore")
        text = max(text, runs(other), key=len)
    return text or None


def pdf_text(data: bytes) -> str | None:
    """Page texts; None if damaged or empty, or if no library for it is installed."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return None
    try:
        return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages) or None
    except Exception:  # noqa: BLE001 - a damaged file of any kind is unreadable
        return None


def extracted(path: str, data: bytes) -> str | None:
    suffix = PurePosixPath(path).suffix.lower().lstrip(".")
    readers = {"docx": docx_text, "doc": doc_text, "wps": doc_text, "pdf": pdf_text, "txt": decoded, "md": decoded, "fountain": decoded}
    return readers[suffix](data) if suffix in readers else None


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """path, suffix, text of every file below root; text is null where a file can't be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):  # a file at a time: contents are large
                path, data = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([extracted(path, data)], pa.string())], names=["path", "text"])

    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    wanted = files.where(suffix.isin(*SUFFIXES))
    return wanted.mapInArrow(run, "path string, text string").select("path", suffix.alias("suffix"), "text").unionByName(files.where(~suffix.isin(*SUFFIXES)).select("path", suffix.alias("suffix"), F.lit(None).cast("string").alias("text")))


def with_sidecars(docs: DataFrame, sidecars: DataFrame) -> DataFrame:
    """docs (path) with claimed_genre and claimed_platform of their sidecars (path, text: `key: value` lines)."""
    value = lambda k: F.nullif(F.regexp_extract("text", rf"(?m)^{k}:\s*['\"]?([^\n'\"]+?)['\"]?\s*$", 1), F.lit(""))
    side = sidecars.select(F.regexp_replace("path", r"\.meta\.ya?ml$", "").alias("__stem"), value("claimed_genre").alias("claimed_genre"), value("claimed_platform").alias("claimed_platform"))
    out = docs.withColumn("__stem", F.regexp_replace("path", r"\.[^./]+$", "")).join(side, "__stem", "left").drop("__stem")
    return out.withColumns({c: F.coalesce(c, F.lit("未声明")) for c in ("claimed_genre", "claimed_platform")})


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """path, sha256 of every file below root, CRLF counted as LF."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    body = _normal(F.col("content"))
    return files.select(F.regexp_replace("path", f"^.*?{re.escape(root.rstrip('/'))}/", "").alias("path"), F.sha2(body, 256).alias("sha256"))


def _normal(content: Column) -> Column:
    """Bytes with CRLF as LF: Latin-1 maps each byte to one character and back."""
    return F.encode(F.replace(F.decode(content, "ISO-8859-1"), F.lit("\r\n"), F.lit("\n")), "ISO-8859-1")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines store; lines that can't be parsed are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt IS NULL").drop("_corrupt")


def write_splits(pairs: DataFrame, path: str) -> DataFrame:
    """Pairs as JSON lines, a folder for each split; returns split, n."""
    pairs.write.partitionBy("split").mode("overwrite").json(path)
    return pairs.groupBy("split").agg(F.count("*").alias("n"))


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def _few(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write them as a table")
    return rows


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small frame as a Markdown table; ValueError if it has more rows than `most`."""
    rows = _few(df, most)
    out = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(out + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


def yaml_text(df: DataFrame, name: str, most: int = 10_000) -> str:
    """A small frame as a YAML list under a name; scalars are written as JSON, which YAML reads. ValueError beyond `most` rows."""
    body = [f"  - {{{', '.join(f'{k}: {json.dumps(v, ensure_ascii=False, default=str)}' for k, v in r.asDict().items())}}}" for r in _few(df, most)]
    return "\n".join([f"{name}:", *body]) + "\n"


def criteria(text: str) -> dict[str, str]:
    """{signal: question} of a Markdown file whose `## ` headings open signals; ValueError if there is none."""
    parts = [p for p in re.split(r"\n(?=## )", "\n" + text) if p.lstrip().startswith("## ")]
    out = {p.lstrip()[3:].split("\n", 1)[0].strip(): p.lstrip().split("\n", 1)[1].strip() if "\n" in p.lstrip() else "" for p in parts}
    if not out:
        raise ValueError("no signal in the criteria")
    return out
