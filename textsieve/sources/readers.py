"""Readers and writers. Every reader gives rows per document or paragraph; the corpus never becomes one string."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the name space of word-processing documents.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SENTENCES = "id string, tokens array<string>"
CORRUPTED = "id string, tokens_clean array<string>, tokens_corrupted array<string>, substitutions array<struct<pos:int,orig:string,new:string>>, deletions array<struct<pos:int,token:string,left:string,right:string>>"


def _paragraphs(content: bytes) -> list[str]:
    """Non-blank paragraphs that stand directly in the body, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for p in [] if body is None else body.findall(f"{_W}p"):
        parts = []
        for e in p.iter():
            if e.tag == f"{_W}t":
                parts.append(e.text or "")
            elif e.tag == f"{_W}tab":
                parts.append("\t")
            elif e.tag in (f"{_W}br", f"{_W}cr"):
                parts.append("\n")
        if text := "".join(parts).strip():
            out.append(text)
    return out


def read_docx_paragraphs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, par_idx, text) of each paragraph."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(path, i, text) for path, content in zip(b["path"], b["content"], strict=True) for i, text in enumerate(_paragraphs(content))]
            yield pd.DataFrame(rows, columns=["path", "par_idx", "text"])

    files = spark.read.format("binaryFile").load(list(paths) if not isinstance(paths, str) else paths)
    return files.select("path", "content").mapInPandas(parse, "path string, par_idx int, text string")


def read_docx(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(doc_id, text) per file, paragraphs joined by line ends. doc_id is the path."""
    p = read_docx_paragraphs(spark, paths).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("par_idx", "text"))).alias("p"))
    return p.select(F.col("path").alias("doc_id"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


def read_text(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(doc_id, text) per file; bytes that are not UTF-8 are dropped, line ends made plain."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [bytes(c).decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") for c in b["content"]]
            yield pd.DataFrame({"doc_id": b["path"], "text": text})

    files = spark.read.format("binaryFile").load(list(paths) if not isinstance(paths, str) else paths)
    return files.select("path", "content").mapInPandas(decode, "doc_id string, text string")


def read_jsonl(spark: SparkSession, path: str, schema: str = SENTENCES) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, ids are text."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("x")).select("x.*")


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line; nulls are kept."""
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).option("header", True).csv(path)


def corrupted_records(corrupted: DataFrame) -> DataFrame:
    """The nested records of synthetic errors, as written."""
    return corrupted.select("id", F.col("tokens").alias("tokens_clean"), "tokens_corrupted", "substitutions", "deletions")


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or a pattern of files is there, in any file system that Spark knows."""
    where, system = _file(spark, path)
    return bool(system.globStatus(where))


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file in any file system that Spark knows; an old one is replaced."""
    where, system = _file(spark, path)
    out = system.create(where, True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def read_file(spark: SparkSession, path: str) -> str:
    """A small file from any file system that Spark knows."""
    return spark.read.text(path, wholetext=True).first()["value"]


def thinned_curves(curves: DataFrame, points: int) -> dict[str, dict[str, list]]:
    """By method the curve as lists, closing point last; of longer curves about `points` evenly spaced ones. The table has all."""
    sizes = curves.groupBy("method").agg(F.max("position").alias("last"))
    step = F.greatest(F.ceil(F.col("last") / points), F.lit(1))
    kept = curves.join(F.broadcast(sizes), "method").where((F.col("position") % step == 0) | (F.col("position") == F.col("last")))
    out: dict[str, dict[str, list]] = {}
    for r in sorted(kept.collect(), key=lambda r: (r["method"], r["position"])):
        c = out.setdefault(r["method"], {"precision": [], "recall": [], "thresholds": []})
        c["precision"].append(r["precision"])
        c["recall"].append(r["recall"])
        if r["threshold"] is not None:
            c["thresholds"].append(r["threshold"])
    return out


def curve_picture(precision: list[float], recall: list[float], title: str) -> str:
    """The curve as a small SVG document."""
    at = " ".join(f"{50 + 400 * r:.1f},{430 - 400 * p:.1f}" for p, r in zip(precision, recall, strict=True))
    return (
        '<svg xmlns="http://www.w3.org/2000/svg" width="480" height="480" font-family="sans-serif" font-size="13">'
        '<rect x="50" y="30" width="400" height="400" fill="none" stroke="#999"/>'
        f'<polyline points="{at}" fill="none" stroke="#1f5fa8" stroke-width="2"/><text x="50" y="20">{title}</text>'
        '<text x="230" y="460">Recall</text><text x="15" y="240" transform="rotate(-90 15 240)">Precision</text></svg>'
    )


def metrics_document(comparison: DataFrame, corrections: DataFrame, params: dict, corpus: dict, weights: dict[str, float], corpus_type: str | None = None, curves: dict | None = None) -> dict:
    """A nested document of a few rows per method and kind, with each method's curve."""
    rows = {r["method"]: {k: r[k] for k in ("average_precision", "precision", "recall", "f1", "threshold")} for r in comparison.collect()}
    for method, curve in (curves or {}).items():
        rows.setdefault(method, {})["pr_curve"] = curve
    found = {r["kind"]: r for r in corrections.collect()}
    correction: dict = {"top_k": params.get("top_k", 5)}
    for kind, short in (("substitution", "subs"), ("deletion", "dels")):
        r = found.get(kind)
        correction |= {f"{short}_top1": r["top1"] if r else 0.0, f"{short}_topk": r["topk"] if r else 0.0, f"{short}_total": r["events"] if r else 0}
    out = {
        "corpus": corpus, "params": params, "token_metrics": {k: v for k, v in rows.items() if k != "gap_score"}, "gap_metrics": {k: v for k, v in rows.items() if k == "gap_score"},
        "classifier_weights": weights, "thresholds": {k: v["threshold"] for k, v in rows.items() if "threshold" in v}, "correction": correction,
    }
    return out | ({"corpus_type": corpus_type} if corpus_type else {})
