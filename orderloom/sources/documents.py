"""Files of all kinds as one table of documents, and documents' stage tables.

`load` reads with Spark's binaryFile source, so listing, splitting by file and retries are Spark's; each file is
decoded by its kind in an Arrow batch. A file that can't be read gives a row with an error and stops nothing.
"""

from __future__ import annotations

import csv
import io
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import charset, html, mail, secure, workbook

# Content types by suffix.
KINDS = {
    "html": "text/html", "htm": "text/html", "eml": "message/rfc822", "mht": "multipart/related", "mhtml": "multipart/related",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xlsm": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xls": "application/vnd.ms-excel", "pdf": "application/pdf", "txt": "text/plain",
}
NO_READER = {"pdf": "a PDF needs a text extractor that isn't installed; load its page texts as .txt"}
SCHEMA = "source_path string, file_name string, content_type string, raw_text string, error string"


class Protected(Exception):
    """A page that holds an encrypted mail: its possible cipher texts."""


def page_text(page: str) -> str:
    return "\n".join(["[HTML 1]", *html.to_lines(html.blocks(page))])


def read_one(raw: bytes, suffix: str, name: str, password: str | None = None) -> str:
    """The raw text of one file: sections with their marks. Raises ValueError for what can't be read, Protected for an
    encrypted page."""
    if suffix in NO_READER:
        raise ValueError(NO_READER[suffix])
    if suffix in ("html", "htm"):
        page = charset.decode(secure.html_member(raw, password) or raw)
        if secure.is_shell(page):
            raise Protected(secure.ciphers(page))
        return page_text(page)
    if suffix == "eml":
        return mail.read_eml(raw, name)
    if suffix in ("mht", "mhtml"):
        return mail.read_mht(raw)
    if suffix in ("xlsx", "xlsm"):
        return workbook.render(workbook.read_xlsx(raw))
    if suffix == "xls":
        if workbook.is_xml_spreadsheet(raw):
            return workbook.render(workbook.read_xml_spreadsheet(raw))
        if raw.startswith(b"PK"):
            return workbook.render(workbook.read_xlsx(raw))
        raise ValueError("a binary workbook needs a reader that isn't installed")
    if suffix == "txt":
        return charset.decode(raw)
    raise ValueError(f"Unsupported file type: .{suffix}")


def resolve(paths: list[str], input_dir: str) -> tuple[list[str], list[str]]:
    """(files, what is missing) of paths as a caller names them, each once, in order: absolute ones as they are; bare names
    below the input folder, else here; others here, else below the input folder."""
    found: list[str] = []
    missing: list[str] = []
    for path in paths:
        here, there = os.path.abspath(path), os.path.join(os.path.abspath(input_dir), path)
        tries = [path] if os.path.isabs(path) else [there, here] if os.path.basename(path) == path else [here, there]
        hit = next((t for t in tries if os.path.isfile(t)), None)
        if hit is None:
            missing.append(path)
        elif hit not in found:
            found.append(hit)
    return found, missing


def load(spark: SparkSession, paths: str | list[str], password: str | None = None, glob: str | None = None) -> DataFrame:
    """One row per file: path, name, content type, raw text, or an error.

    Encrypted pages are decrypted between two passes, by expressions, if a password is given; else they are an error.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(paths).select("path", "content")
    names = ["source_path", "file_name", "content_type", "raw_text", "error", "ciphers"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = path.rsplit("/", 1)[-1]
                suffix = name.rsplit(".", 1)[-1].lower() if "." in name else ""
                text, error, found = None, None, None
                try:
                    text = read_one(raw, suffix, name, password)
                    if not text.strip():
                        text, error = None, "no text found"
                except Protected as e:
                    error, found = "protected page: no password, or not the right one", e.args[0]
                except Exception as e:  # one unreadable file mustn't stop the others
                    error = f"{type(e).__name__}: {e}"[:500]
                out.append((path, name, KINDS.get(suffix), text, error, found))
            if out:
                *text_columns, found = zip(*out)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in text_columns), pa.array(found, pa.list_(pa.string()))], names)

    read = files.mapInArrow(run, f"{SCHEMA}, ciphers array<string>")
    if password is None:
        return read.drop("ciphers")
    opened = F.transform("ciphers", lambda c: F.try_validate_utf8(secure.decrypt(c, F.lit(password)).cast("string")))
    page = F.get(F.filter(opened, lambda p: p.contains("<")), F.lit(0))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(5).to_pylist()
            texts = [page_text(p) if p else t for p, t in zip(pages, batch.column(3).to_pylist())]
            errors = [None if p else e for p, e in zip(pages, batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names[:5])

    return read.withColumn("page", page).select(*names[:5], "page").mapInArrow(parse, SCHEMA)


HANDOFF = (
    "source_path string, file_name string, content_type string, raw_text string, markdown_text string, chunks array<string>, non_instruction_reason string, allow_empty_result boolean, "
    "scope_excludes_all_funds boolean, expected_order_count int, target_fund_scope struct<manager_column_present: boolean, include_all_funds: boolean, fund_codes: array<string>, fund_names: array<string>, "
    "canonical_fund_names: array<string>>, markdown_loss_detected boolean, markdown_loss_reasons array<string>, effective_llm_text_kind string"
)


def read_handoff(spark: SparkSession, path: str) -> DataFrame:
    """Task payloads from JSON lines; missing fields take their defaults, an unknown kind of text is markdown_text."""
    d = spark.read.schema(HANDOFF).json(path)
    kind = F.col("effective_llm_text_kind")
    return d.withColumns(
        {
            "chunks": F.coalesce("chunks", F.array().cast("array<string>")),
            "allow_empty_result": F.coalesce("allow_empty_result", F.lit(False)),
            "scope_excludes_all_funds": F.coalesce("scope_excludes_all_funds", F.lit(False)),
            "expected_order_count": F.coalesce("expected_order_count", F.lit(0)),
            "markdown_loss_detected": F.coalesce("markdown_loss_detected", F.lit(False)),
            "effective_llm_text_kind": F.when(kind.isin("markdown_text", "raw_text"), kind).otherwise("markdown_text"),
        }
    )


def write_handoff(df: DataFrame, path: str, run: str) -> None:
    """Task payloads as JSON lines under a folder of the run; passwords are never written."""
    df.drop("pdf_password", "password").write.mode("errorifexists").json(f"{path}/run={run}")


def orders_csv(rows: list[tuple], fields: list[str]) -> bytes:
    """One CSV file with a byte-order mark, as spreadsheets expect it: for results of a size a person reads."""
    out = io.StringIO()
    w = csv.writer(out)
    w.writerow(fields)
    w.writerows(["" if x is None else x for x in r] for r in rows)
    return out.getvalue().encode("utf-8-sig")


def write_orders(df: DataFrame, path: str, run: str) -> None:
    """Flat order rows as CSV with a header, one folder a run; written by the executors."""
    df.write.mode("errorifexists").option("header", "true").csv(f"{path}/run={run}")
