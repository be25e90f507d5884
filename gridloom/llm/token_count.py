"""Token counts of whole texts; huge texts by overlap resynchronisation.

A text of more than ``chunk_chars`` characters is encoded in overlapping chunks, with offsets.
Inside an overlap, a place where both encodings start a new word is a stable boundary: the word
splitter reads from left to right and remembers nothing but its place, so two runs that break at
the same place agree from there on.  Places near the end of a chunk are not used, since words
there may be cut short.  The count goes on in the next chunk at the first stable boundary.  Where
an overlap has none, it is doubled, and then the chunk itself, until one is found or the text ends.

No shuffle; memory is bounded by a batch of rows and one chunk's encoding.  Defined results: a
null text counts as empty (no bytes, no tokens); rows are counted one by one, so repeated rows
repeat and an empty table gives an empty one; extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.tokens import load

#: Characters before a chunk's end in which no boundary is trusted, unless a special string is longer.
MARGIN = 64


def _margin(tokenizer) -> int:
    return max([MARGIN, *(2 * len(t.content) for t in tokenizer.get_added_tokens_decoder().values())])


def _starts(encoding) -> dict[int, int]:
    """Place of each word's first character -> index of the word's first token."""
    out, last = {}, object()
    for i, (word, (a, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if word is None or word != last:
            out.setdefault(a, i)
        last = word
    return out


def count_chunked(tokenizer, text: str, chunk_chars: int, overlap_chars: int) -> tuple[int, int]:
    """Tokens of ``text`` and the number of chunks they were spliced from."""
    encode = lambda a, b: tokenizer.encode(text[a:b], add_special_tokens=False)
    margin = _margin(tokenizer)
    n, start, lead, total, chunks = len(text), 0, 0, 0, 1
    end = min(n, chunk_chars)
    here = encode(start, end)
    while end < n:
        overlap, found = overlap_chars, None
        own = _starts(here)
        while found is None:
            if overlap > (end - start) // 2:  # no room left: a longer chunk instead
                end = min(n, end + (end - start))
                here = encode(start, end)
                if end == n:
                    break
                own = _starts(here)
            begin = end - overlap
            after = min(n, begin + chunk_chars)
            if after <= end:
                after = min(n, end + overlap)
            there = encode(begin, after)
            # The first place of a chunk is no boundary of the text, only of the cut.
            other = {p + begin: i for p, i in _starts(there).items() if p > 0}
            same = [(p + start, i) for p, i in own.items() if i >= lead and begin < p + start <= end - margin and p + start in other]
            if same:
                found = min(same)
            else:
                overlap *= 2
        if found is None:
            break
        place, index = found
        total += index - lead
        start, end, here, lead = begin, after, there, other[place]
        chunks += 1
    return total + len(here.ids) - lead, chunks


def count_tokens(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    limit: int = 1024,
    chunk_chars: int = 32_768,
    overlap_chars: int = 512,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit, n_chunks (1 for a text that was encoded in one go)."""
    df = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    kind = df.schema["_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, _ = load(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                counts, chunks = [0] * len(texts), [1] * len(texts)
                short = [i for i, t in enumerate(texts) if len(t) <= chunk_chars]
                for i, e in zip(short, library.encode_batch_fast([texts[i] for i in short], add_special_tokens=False), strict=True):
                    counts[i] = len(e)
                for i, t in enumerate(texts):
                    if len(t) > chunk_chars:
                        counts[i], chunks[i] = count_chunked(library, t, chunk_chars, overlap_chars)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(chunks, pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64())],
                    names=["_id", "n_tokens", "n_chunks", "n_bytes"],
                )

    counted = df.mapInArrow(run, f"_id {kind.simpleString()}, n_tokens bigint, n_chunks bigint, n_bytes bigint")
    return counted.select(F.col("_id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chunks")
