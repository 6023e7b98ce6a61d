"""Language by compression: the language whose zstandard dictionary makes a text smallest.

Texts are read in lower case without ASCII signs and digits. Each language's dictionary is raw text of its own: slices of at most `texts` training texts (those with the smallest hash
of doc_id), `size` bytes in all, shared among them. A text is cut into blocks that cover all of it, each is compressed with each
dictionary, and the sizes are summed. The margin is how much larger the second-best sum is; texts whose margin is below
`narrow` are marked as not accepted.

Defined cases: null text or text without a letter is `und` with score 0; without any training text all are `und`; ties
go to the language with more training texts; repeated rows are judged each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censusflow.llm.common import pieces

SIZE, TEXTS, BLOCK, LEVEL, NARROW = 32 << 10, 400, 2048, 6, 0.01
_LETTER = re.compile(r"[A-Za-z]")
_NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha() and chr(c) not in " \n'")


def plain(text: bytes) -> bytes:
    """Lower case, without ASCII signs, digits and control characters."""
    return text.decode().lower().encode().translate(None, _NOT_LETTERS)


def letters(text: str) -> bool:
    return bool(_LETTER.search(text)) or any(c.isalpha() for c in text)


def _slices(each: int):
    """Three slices of each text, spread over it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            out = []
            for t in map(plain, texts):
                n = each // 3
                out.append(b"\n".join(t[a : a + n] for a in sorted({0, max(0, len(t) // 2 - n // 2), max(0, len(t) - n)})))
            yield pa.record_batch([batch.column("lang"), batch.column("doc_id"), pa.array(out, pa.binary())], names=["lang", "doc_id", "part"])

    return work


def dictionaries(docs: DataFrame, size: int = SIZE, texts: int = TEXTS) -> dict[str, bytes]:
    """Raw dictionary of each language. docs: training rows with doc_id, text, lang. Languages are few by nature."""
    rows = docs.select("doc_id", "lang").where("lang is not null")
    langs = [r["lang"] for r in rows.groupBy("lang").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "lang").collect()]
    picked = None
    for lang in langs:
        part = rows.where(F.col("lang") == lang).orderBy(F.xxhash64("doc_id"), "doc_id").limit(texts)
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        return {}
    found = docs.select("doc_id", "text", "lang").join(F.broadcast(picked.distinct()), ["doc_id", "lang"]).select("doc_id", "lang", "text")
    parts = sorted(found.mapInArrow(_slices(max(300, 2 * size // texts)), "lang string, doc_id long, part binary").collect(), key=lambda r: (r["lang"], r["doc_id"] or 0, bytes(r["part"])))
    return {lang: shared([bytes(r["part"]) for r in parts if r["lang"] == lang], size) for lang in langs}


def shared(parts: list[bytes], size: int) -> bytes:
    """All parts in `size` bytes; each is cut to an equal share, and what short ones leave goes to the others."""
    left, room = len(parts), size - len(parts) + 1  # line breaks between them
    keep = [0] * len(parts)
    for i in sorted(range(len(parts)), key=lambda i: len(parts[i])):
        keep[i] = min(len(parts[i]), max(0, room) // left)
        room -= keep[i]
        left -= 1
    return b"\n".join(t[:n] for t, n in zip(parts, keep, strict=True))[:size]


class Compressors:
    def __init__(self, raw: dict[str, bytes], level: int = LEVEL):
        import zstandard as z

        self.langs = list(raw)
        self.each = []
        for data in raw.values():
            d = z.ZstdCompressionDict(data or b" " * 8, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.each.append(z.ZstdCompressor(dict_data=d, level=level, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def sizes(self, text: bytes, block: int) -> list[int]:
        parts = [text[i : i + block] for i in range(0, len(text), block)]
        return [sum(len(c(p)) for p in parts) for c in self.each]


def judged(sizes: list[int]) -> tuple[int, float, float]:
    """Best index, score from 0 to 1, margin to the second."""
    best = min(range(len(sizes)), key=sizes.__getitem__)
    rel = [(s - sizes[best]) / max(1, sizes[best]) for s in sizes]
    margin = min((r for i, r in enumerate(rel) if i != best), default=1.0)
    return best, 1 / sum(math.exp(-60 * r) for r in rel), margin


def _judge(sent, block: int, narrow: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Compressors(sent.value)
        for batch, texts in pieces(batches):
            lang, score, ok = [], [], []
            for t in texts:
                if not c.langs or not letters(t.decode()):
                    lang.append("und")
                    score.append(0.0)
                    ok.append(False)
                    continue
                best, s, margin = judged(c.sizes(plain(t), block))
                lang.append(c.langs[best])
                score.append(s)
                ok.append(margin >= narrow)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return work


def identify(docs: DataFrame, held_out: Column, size: int = SIZE, texts: int = TEXTS, block: int = BLOCK, narrow: float = NARROW) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted; rows where held_out is true never teach."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries(docs.where(~held_out), size, texts))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return rows.mapInArrow(_judge(sent, block, narrow), "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
