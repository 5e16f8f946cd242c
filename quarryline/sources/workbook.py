"""A Python data source for gold workbooks: xlsx sheets as record rows.

    spark.dataSource.register(GoldWorkbook)
    spark.read.format("gold_workbook").load("/path/*.xlsx")

A sheet is an economy; sheets of IGNORED names are left out. The first row that has the known headers
maps the columns; later rows with an indicator of a mandatory pillar, and an act or an address, are
records. Each file is one partition. Only the standard library is needed.
"""

from __future__ import annotations

import glob
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Sheets that aren't economies, the pillars scored, the headers (exact, or by their start).
IGNORED = frozenset(("RDTII 2.1 Methodology", "Consolidated"))
PILLARS = (6, 7)
EXACT = {"pillar_id": "pillar", "indicator_id": "indicator"}
STARTS = {"raw score": "score", "act": "act", "coverage": "coverage", "impact": "impact", "timeframe": "timeframe", "reference": "references"}
REQUIRED = frozenset(("pillar", "indicator", "act", "coverage", "impact", "timeframe", "references"))
_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def detect_columns(row: list[str]) -> dict[str, int] | None:
    """Places of the known headers, a later one over an earlier; None unless all but the score are there."""
    at: dict[str, int] = {}
    for i, cell in enumerate(row):
        name = cell.strip().lower()
        field = EXACT.get(name) or next((f for s, f in STARTS.items() if name.startswith(s)), None)
        if field:
            at[field] = i
    return at if REQUIRED <= at.keys() else None


def collect_urls(cells: list[str]) -> list[str]:
    return [u for c in cells for u in (p.strip() for p in re.split(r"[\n;]+", c)) if re.match(r"(?i)https?://|www\.", u)]


def safe_float(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def parse_sheet(rows: Iterator[list[str]], country: str) -> Iterator[tuple]:
    """Records (country, pillar_id, indicator_id, act_name, coverage, impact, timeframe, raw_score, urls)."""
    at = None
    for row in rows:
        if not any(row):
            continue
        if at is None:
            at = detect_columns(row)
            continue
        cell = lambda k, row=row: row[at[k]].strip() if k in at and at[k] < len(row) else ""
        pillar = safe_float(cell("pillar"))
        if not re.match(r"\d+\.\d+", cell("indicator")) or pillar is None or int(pillar) not in PILLARS:
            continue
        urls = collect_urls(row[at["references"] :])
        if cell("act") or urls:
            yield country, int(pillar), cell("indicator"), cell("act"), cell("coverage"), cell("impact"), cell("timeframe"), safe_float(cell("score")), urls


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheets(path: str) -> Iterator[tuple[str, Iterator[list[str]]]]:
    """Each sheet's name and its rows of texts."""
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_M}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_M}si")]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_M}sheet"):
            target = links[s.get(f"{_R}id")].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))

            def rows(root=root) -> Iterator[list[str]]:
                for r in root.iter(f"{_M}row"):
                    out: list[str] = []
                    for c in r.iter(f"{_M}c"):
                        i = _column(c.get("r")) if c.get("r") else len(out)
                        out.extend([""] * (i + 1 - len(out)))
                        v = c.find(f"{_M}v")
                        if c.get("t") == "inlineStr":
                            out[i] = "".join(t.text or "" for t in c.iter(f"{_M}t"))
                        elif v is not None:
                            out[i] = shared[int(v.text)] if c.get("t") == "s" else v.text or ""
                    yield out

            yield s.get("name"), rows()


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        files = sorted(glob.glob(os.path.join(self.path, "*.xlsx") if os.path.isdir(self.path) else self.path))
        return [InputPartition(f) for f in files]

    def read(self, partition):
        for name, rows in sheets(partition.value):
            if name not in IGNORED:
                yield from parse_sheet(rows, name)


class GoldWorkbook(DataSource):
    @classmethod
    def name(cls):
        return "gold_workbook"

    def schema(self):
        return "country string, pillar_id int, indicator_id string, act_name string, coverage string, impact string, timeframe string, raw_score double, urls array<string>"

    def reader(self, schema):
        return _Reader(self.options)
