"""Sections of a report as JSON, HTML, spreadsheet, document, or tables.

JSON and HTML lines are built by the executors; spreadsheets and documents are single files by nature and take a
section's rows through the driver one at a time, up to the format's own limit.
"""

from __future__ import annotations

import io
import json
import os
import zipfile
from collections.abc import Callable, Iterator
from typing import BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.operators.cleaning import escape_html

# Sections and their columns.
SECTIONS = {
    "People": ["name", "address", "company", "role"],
    "Specifications": ["category", "value", "unit", "subject", "raw_match", "mentioned_by", "date_str", "source_file"],
    "Eng Sentences": ["sentence", "trigger_keywords", "is_unresolved", "mentioned_by", "date_str", "source_file"],
    "Unresolved": ["sentence", "trigger_keywords", "mentioned_by", "date_str", "source_file"],
    "Timeline": ["date", "sentence", "mentioned_by"],
}
#: Rows that one sheet can hold.
SHEET_ROWS = 1_048_575


def as_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """The section's columns as texts: lists joined by ", ", true as Yes, false and NULL as ""."""
    kinds = dict(df.dtypes)

    def text(c: str) -> Column:
        if kinds[c].startswith("array"):
            return F.coalesce(F.array_join(c, ", "), F.lit("")).alias(c)
        if kinds[c] == "boolean":
            return F.when(F.col(c), "Yes").otherwise("").alias(c)
        return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    return df.select(*[text(c) for c in columns if c in kinds])


def json_lines(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, json): each row of each section as a JSON object, with all its fields."""
    out = None
    for name, df in sections.items():
        x = df.select(F.lit(name).alias("section"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
        out = x if out is None else out.unionByName(x)
    return out


def html_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(row): table rows of a section, all text escaped."""
    x = as_text(df, columns)
    cells = [F.concat(F.lit("<td>"), escape_html(F.col(c)), F.lit("</td>")) for c in x.columns]
    return x.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("row"))


def write_html(path: str, sections: dict[str, DataFrame], title: str = "Mail report") -> None:
    """One self-contained file: counters, then a table per section; empty sections say so."""
    with open(path, "w", encoding="utf-8") as f:
        t = escape(title)
        f.write(f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{t}</title></head><body><h1>{t}</h1><ul>")
        for name, df in sections.items():
            f.write(f"<li>{escape(name)}: {df.count()}</li>")
        f.write("</ul>")
        for name, df in sections.items():
            cols = [c for c in SECTIONS.get(name, df.columns) if c in df.columns]
            f.write(f"<h2>{escape(name)}</h2><table><tr>" + "".join(f"<th>{escape(c)}</th>" for c in cols) + "</tr>")
            n = 0
            for r in html_rows(df, cols).toLocalIterator():
                f.write(r["row"])
                n += 1
            f.write("</table>" if n else "</table><p>Nothing found.</p>")
        f.write("</body></html>")


#: Characters that a spreadsheet's cell can hold; longer texts end there, in that format only.
CELL_CHARS = 32_767


def _cell(text: str, most: int | None = None) -> str:
    return "".join(c for c in escape(text[:most]) if c >= " " or c in "\t\n")


def write_xlsx(path: str | BinaryIO, sections: dict[str, DataFrame]) -> None:
    """A workbook with a sheet per section, headers always, columns as wide as their texts up to 60; written part by part."""
    names = list(sections)
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook {ns} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)[:31]}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, name in enumerate(names, 1):
            df = sections[name]
            cols = [c for c in SECTIONS.get(name, df.columns) if c in df.columns]
            x = as_text(df, cols)
            widths = x.agg(*[F.max(F.length(c)).alias(c) for c in cols]).first() if cols else None
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                w = lambda s, f=f: f.write(s.encode("utf-8"))
                w(f'<?xml version="1.0"?><worksheet {ns}><cols>')
                for k, c in enumerate(cols, 1):
                    w(f'<col min="{k}" max="{k}" width="{min(max(len(c), widths[c] or 0) + 2, 60)}" customWidth="1"/>')
                w("</cols><sheetData>")
                row = lambda values: "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{_cell(v, CELL_CHARS)}</t></is></c>' for v in values) + "</row>"
                w(row(cols))
                for n, r in enumerate(x.toLocalIterator(), 1):
                    if n > SHEET_ROWS:
                        raise ValueError(f"{name} has more rows than a sheet holds; write tables instead")
                    w(row(r))
                w("</sheetData></worksheet>")


def write_docx(path: str | BinaryIO, sections: dict[str, DataFrame], title: str = "Mail report") -> None:
    """A document with a heading and a table per section; an empty section says so."""
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t xml:space=\"preserve\">{_cell(t)}</w:t></w:r></w:p>"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        with z.open("word/document.xml", "w") as f:
            w = lambda s: f.write(s.encode("utf-8"))
            w(f'<?xml version="1.0"?><w:document {ns}><w:body>{p(title)}')
            for name, df in sections.items():
                cols = [c for c in SECTIONS.get(name, df.columns) if c in df.columns]
                w(p(name))
                row = lambda values: "<w:tr>" + "".join(f"<w:tc>{p(v)}</w:tc>" for v in values) + "</w:tr>"
                n = 0
                for r in as_text(df, cols).toLocalIterator():
                    if not n:
                        w("<w:tbl>" + row(cols))
                    w(row(r))
                    n += 1
                w("</w:tbl>" if n else p("Nothing found."))
            w("</w:body></w:document>")


def read_xlsx(path: str | BinaryIO) -> dict[str, list[list[str]]]:
    """Rows of each sheet of a workbook with inline texts, headers first."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path) as z:
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{ns}sheet")]
        return {n: [["".join(t.text or "" for t in c.iter(f"{ns}t")) for c in r.iter(f"{ns}c")] for r in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{ns}row")] for i, n in enumerate(names, 1)}


def read_docx(path: str | BinaryIO) -> list[list[list[str]]]:
    """Rows of each table of a document, headers first."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(path) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    return [[["".join(t.text or "" for t in c.iter(f"{ns}t")) for c in r.iter(f"{ns}tc")] for r in t.iter(f"{ns}tr")] for t in body.iter(f"{ns}tbl")]


#: Sections of the response, by their names in a report; its field names are those that callers expect.
RESPONSE = {"Specifications": "specs", "People": "people", "Eng Sentences": "tagged_sentences", "Unresolved": "unresolved_items", "Conflicts": "conflicts", "Timeline": "timeline"}


def response(sections: dict[str, DataFrame]) -> dict:
    """{status, metrics} of a request: the number of mails, its sections as lists of objects, the summary. For the mails of one
    request, whose number is bounded; the sink for sections of any size is write_tables."""
    metrics: dict[str, object] = {"emails_processed": sections["Mails"].count()}
    for name, key in RESPONSE.items():
        metrics[key] = [json.loads(r[0]) for r in sections[name].select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    lines = [r["summary"] for r in sections["Summary"].select("summary").collect()]
    metrics["summary"] = "\n\n".join(lines) if lines else "No mails were analyzed."
    return {"status": "success", "metrics": metrics}


def write_json(path: str, sections: dict[str, DataFrame]) -> None:
    """One object with a list for each section, written row by row."""
    with open(path, "w", encoding="utf-8") as f:
        for n, (name, df) in enumerate(sections.items()):
            f.write(("," if n else "{") + json.dumps(name) + ":[")
            for k, r in enumerate(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()):
                f.write(("," if k else "") + r[0])
            f.write("]")
        f.write("}" if sections else "{}")


def report_files(sections: dict[str, DataFrame], forms: tuple[str, ...] = ("docx", "xlsx")) -> dict[str, bytes]:
    """name -> content of reports to download."""
    out = {}
    for form in forms:
        held = io.BytesIO()
        {"docx": write_docx, "xlsx": write_xlsx}[form](held, sections)
        out[f"report.{form}"] = held.getvalue()
    return out


def write_back(summaries: DataFrame, make_client: Callable[[], object], field: str = "summary") -> None:
    """Hand each thread's summary to a client's update(thread_id, {field: text}), one client for each partition."""

    def send(rows: Iterator) -> None:
        client = make_client()
        for r in rows:
            client.update(r["thread_id"], {field: r["summary"]})

    summaries.select("thread_id", "summary").foreachPartition(send)


def write_tables(path: str, sections: dict[str, DataFrame]) -> None:
    """A Parquet table per section: the sink for sections of any size."""
    for name, df in sections.items():
        df.write.mode("overwrite").parquet(os.path.join(path, name.lower().replace(" ", "_")))


SINKS = {"json": write_json, "html": write_html, "xlsx": write_xlsx, "excel": write_xlsx, "docx": write_docx, "tables": write_tables}


def write_report(path: str, sections: dict[str, DataFrame], form: str = "all") -> list[str]:
    """Write one form, or all of docx, xlsx and html, into the folder path; the files' names."""
    done = []
    for f in ("docx", "xlsx", "html") if form == "all" else (form,):
        to = path if f == "tables" else os.path.join(path, f"report.{'xlsx' if f == 'excel' else f}")
        SINKS[f](to, sections)
        done.append(to)
    return done
