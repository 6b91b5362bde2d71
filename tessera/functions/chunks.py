"""Documents in chunks: by headings and pages where they have some, else by a sliding window of words."""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from itertools import accumulate, groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is a heading (marked, numbered, all in capitals) and a page mark, and the sizes in words.
MARKED = re.compile(r"(#{1,6})\s+(.*?)\s*")
NUMBERED = re.compile(r"(\d+(?:\.\d+)*)\s+([A-Z].*?)\s*")
CAPITALS = re.compile(r"[A-Z0-9][A-Z0-9 ,:/&()'\".-]{4,}")
PAGE = re.compile(r"\s*---\s*page\s+(\d+)\s*---\s*", re.IGNORECASE)
LEAST, MOST, WINDOW, OVERLAP = 200, 1500, 800, 100
#: Rows in an Arrow batch, and characters of texts of which chunks are held at a time.
BATCH_ROWS, HELD_CHARS = 500, 500_000
CHUNK = "title string, body string, breadcrumb string, source_ref string, chunk_index long, total_chunks long"


def heading(line: str) -> tuple[int, str] | None:
    """Level and text of a heading."""
    line = line.strip()
    words = len(line.split())
    if found := MARKED.fullmatch(line):
        return len(found[1]), found[2].strip()
    if words <= 14 and line[-1:] not in (".", ":", ";") and (found := NUMBERED.fullmatch(line)):
        return min(6, found[1].count(".") + 1), line
    if words <= 12 and CAPITALS.fullmatch(line):
        return 2, line.title()
    return None


def _reference(base: str, breadcrumb: str, pages: set[int], part: str = "") -> str:
    span = f"page {min(pages)}" if len(pages) == 1 else f"pages {min(pages)}-{max(pages)}" if pages else ""
    return ", ".join(x for x in (base, breadcrumb, span, part) if x)


def sections(text: str, title: str) -> list[dict]:
    """Sections with a body, in order: title, body, pages, and the breadcrumb of the headings above."""
    lines = [(line, heading(line) if not PAGE.fullmatch(line) else None) for line in text.splitlines()]
    number = list(accumulate(h is not None for _, h in lines))
    out, above, name = [], [(0, title)], title
    for _, group in groupby(zip(number, lines), key=lambda x: x[0]):
        own = [x for _, x in group]
        if own[0][1]:
            level, name = own[0][1]
            if level != 1 or name.lower() != title.lower():
                above = [*(a for a in above if a[0] < level), (level, name)]
        marks = [PAGE.fullmatch(line) for line, h in own if not h]
        body = "\n".join(line for (line, h), mark in zip([x for x in own if not x[1]], marks) if not mark).strip()
        if body:
            out.append({"title": name, "body": body, "pages": {int(m[1]) for m in marks if m}, "breadcrumb": " > ".join(a[1] for a in above if a[1])})
    return out


def chunks_of(text: str | None, title: str | None, base: str | None = None, mode: str = "auto", least: int = LEAST, most: int = MOST, window: int = WINDOW, overlap: int = OVERLAP) -> list[tuple]:
    """(title, body, breadcrumb, source_ref) of each chunk. A section of fewer than `least` words goes in front of the
    next one, one of more than `most` is cut between paragraphs. Without a heading, or in mode "sliding", chunks are
    windows that overlap. Null and blank texts have none."""
    text, title = (text or "").strip(), (title or "").strip() or "document"
    base = (base or "").strip() or title
    if not text:
        return []
    if mode == "sliding" or mode == "auto" and not any(map(heading, text.splitlines())):
        words = " ".join(line for line in text.splitlines() if not PAGE.fullmatch(line)).split()
        if len(words) <= window:
            return [(title, text, title, base)] if words else []
        n = 1 + -(-(len(words) - window) // max(1, window - overlap))
        starts = [i * max(1, window - overlap) for i in range(n)]
        return [(f"{title} — segment {i + 1}", " ".join(words[a : a + window]), f"{title} > segment {i + 1}", f"{base}, segment {i + 1}") for i, a in enumerate(starts)]
    found = sections(text, title)
    large = [len(s["body"].split()) >= least for s in found[:-1]] + [True]  # each of these takes in those before it
    ends = [i for i, x in enumerate(large[: len(found)]) if x]
    out = []
    for end, start in zip(ends, [0, *(e + 1 for e in ends)]):
        small, last = found[start:end], found[end]
        body = "\n".join([*(line for s in small for line in (f"## {s['title']}", s["body"], "")), last["body"]]).strip()
        pages = set().union(*(s["pages"] for s in found[start : end + 1]))
        if len(body.split()) <= most:
            out.append((last["title"], body, last["breadcrumb"], _reference(base, last["breadcrumb"], pages)))
            continue
        parts = _packed([p.strip() for p in re.split(r"\n\s*\n", body) if p.strip()], most)
        for i, part in enumerate(parts):
            label = f"part {i + 1} of {len(parts)}"
            out.append((f"{last['title']} ({label})", part, f"{last['breadcrumb']} > {label}", _reference(base, last["breadcrumb"], pages, label)))
    return out


def _packed(paragraphs: list[str], most: int) -> list[str]:
    """Paragraphs in a row, as many as have `most` words together."""
    ends = [0, *accumulate(len(p.split()) for p in paragraphs)]
    out, at = [], 0
    while at < len(paragraphs):
        to = max(at + 1, bisect(ends, ends[at] + most) - 1)
        out.append("\n\n".join(paragraphs[at:to]))
        at = to
    return out


def _slices(columns: tuple[pa.Array, ...], most: int = HELD_CHARS) -> Iterator[list[pa.Array]]:
    """Rows of the columns, the first of which has the texts, as many at a time as have `most` characters together."""
    ends = [0, *accumulate(n or 0 for n in pc.utf8_length(columns[0]).to_pylist())]
    at = 0
    while at < len(columns[0]):
        to = max(at + 1, bisect(ends, ends[at] + most) - 1)
        yield [c.slice(at, to - at) for c in columns]
        at = to


def chunked(docs: DataFrame, text: Column, title: Column, base: Column | None = None, mode: str = "auto", **sizes: int) -> DataFrame:
    """docs with one row for each chunk of the text, and the columns of CHUNK beside its own; columns of these names
    are replaced. A line's meaning depends on those before it, so the scan is Python's, in small Arrow
    batches; chunks are held for few texts at a time."""

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(docs.sparkSession.conf.get(key)) <= BATCH_ROWS:
        docs.sparkSession.conf.set(key, str(BATCH_ROWS))

    @F.arrow_udf(f"array<struct<{CHUNK.replace(' ', ':').replace(',:', ',')}>>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        names = [x.split()[0] for x in CHUNK.split(", ")]
        kinds = pa.list_(pa.struct([(n, pa.int64() if i > 3 else pa.string()) for i, n in enumerate(names)]))
        for batch in batches:
            parts = [pa.array([], kinds)]
            for columns in _slices(batch):
                rows = [chunks_of(*x, mode=mode, **sizes) for x in zip(*(c.to_pylist() for c in columns))]
                parts.append(pa.array([[dict(zip(names, (*c, i, len(own)))) for i, c in enumerate(own)] for own in rows], kinds))
            yield pa.concat_arrays(parts)

    kept = [c for c in docs.columns if c not in [x.split()[0] for x in CHUNK.split(", ")]]
    both = docs.select(F.struct(*docs.columns).alias("row"), cut(text, title, title if base is None else base).alias("chunks"))
    return both.select("row", F.inline("chunks")).select(*(F.col("row")[c].alias(c) for c in kept), *(x.split()[0] for x in CHUNK.split(", ")))
