"""Filing documents to facts. The XML itself is the only thing Python workers read."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACTS = "doc_id string, seq int, tag string, member string, value string, error string, recovered boolean"
CONTEXT = "context"
_AXIS = "CategoryOfShareholdersAxis"
_CHUNK = 50_000
_STRAY = re.compile(rb"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)")


def _local(name: str) -> str:
    return name.rsplit("}", 1)[-1].rsplit(":", 1)[-1]


def _parse(content: bytes) -> tuple[ElementTree.Element, bool]:
    """The document's root, and whether stray entities had to be made plain text first."""
    try:
        return ElementTree.fromstring(content), False
    except (ElementTree.ParseError, ValueError, LookupError):
        plain = _STRAY.sub(b"&amp;", content)
        if plain == content:
            raise
        return ElementTree.fromstring(plain), True


def _facts(doc_id: str, content: bytes) -> list[tuple]:
    """Facts of one document in document order; contexts are listed with the member they stand for."""
    if not content:
        return [(doc_id, 0, None, None, None, "empty file", False)]
    try:
        root, recovered = _parse(content)
    except (ElementTree.ParseError, ValueError, LookupError) as exc:
        return [(doc_id, 0, None, None, None, f"malformed XML: {exc}", False)]
    members: dict[str | None, str | None] = {}
    inside: set[int] = set()
    for context in (e for e in root.iter() if _local(e.tag) == CONTEXT):
        member = None
        for e in context.iter():
            inside.add(id(e))
            if _local(e.tag) == "explicitMember" and _local(e.get("dimension") or "") == _AXIS:
                member = _local((e.text or "").strip())
        members[context.get("id")] = member
    rows = [(doc_id, i, CONTEXT, m, None, None, recovered) for i, m in enumerate(members.values())]
    for e in root.iter():
        if id(e) in inside or len(e):
            continue
        rows.append((doc_id, len(rows), _local(e.tag), members.get(e.get("contextRef")), (e.text or "").strip(), None, recovered))
    return rows


def shred_filing_facts(documents: DataFrame, doc_id: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc_id, seq, tag, member, value, error, recovered): every fact of every document; a bad document is one error row.

    A document with unknown entities or bare ampersands is read with those as plain text, and marked ``recovered``.
    """
    names = [f.split()[0] for f in FACTS.split(", ")]

    def shred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for key, body in zip(batch["doc_id"], batch["content"], strict=True):
                rows.extend(_facts(key, body))
                if len(rows) >= _CHUNK:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return documents.select(
        F.col(doc_id).cast("string").alias("doc_id"), F.col(content).cast("binary").alias("content")
    ).mapInPandas(shred, FACTS)
