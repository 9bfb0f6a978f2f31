"""Pack tokenized documents into windows of fixed length by minimum bin slack.

A document becomes token ids and a closing id, cut into pieces of exactly one window, which need no
packing, and one remainder.  Remainders are dealt into groups of about ``group_rows`` by a hash; a group is
packed by one task that holds only five numbers for each remainder.

Minimum bin slack: a window opens with the longest remainder left.  A dynamic programme over the multiset of the
other lengths, kept as bits of one integer (bit s: the sum s can be reached), finds the sum closest to
the room that is left; walking the stored states backwards gives how many of each length make it up.
The programme stops as soon as the window can be filled exactly.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import compress, pairwise
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskgraph.llm.common import stored, worker_cache
from deskgraph.llm.merges import END, ranked

WINDOW = 2048
END_ID = 1
GROUP_ROWS = 50_000
CACHED_WORDS = 300_000
#: Letters below this are composed already and lower-cased alike everywhere.
LATIN = "\u0250"
#: Marks after a word, which the tokenizer takes apart from it.
MARKS = ".,!?;:|&%$#*\""

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, piece_key long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def word_encoder(tokenizer_path: str, cached: int = CACHED_WORDS) -> Callable[[list[str]], list[bytes]]:
    """Texts to their ids as little-endian 32-bit bytes, by a tokenizer that works within words.

    The tokenizer's normaliser drops white space between words, so a text's ids are those of its chunks between spaces or
    line ends in turn.  Chunks are encoded once for each worker and kept in two generations, ``cached`` at most: when the newer is
    full it becomes the older, and what is asked for again moves over, so frequent words stay.
    A chunk of Latin letters is one word to the tokenizer, which lower-cases it and joins its bytes by merges: such words go to
    the same vocabulary as ranks, all at once.  Any other chunk, also one that holds a special token, takes the whole tokenizer.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    held = worker_cache(f"encoder:{tokenizer_path}")
    if "tokenizer" not in held:
        tokenizer = Tokenizer.from_file(tokenizer_path)
        held.update(tokenizer=tokenizer, ranks=ranked(tokenizer, tokenizer_path), words={}, older={}, letters={}, marks={})
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        held["ends"] = np.array([(tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
    tokenizer, ranks, ends, marks = held["tokenizer"], held["ranks"], held["ends"], held["marks"]

    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def marked(tail: str) -> bytes:
        """Ids of the marks after a word, of which there are few."""
        if tail not in marks:
            marks[tail] = packed(tokenizer.encode(tail, add_special_tokens=False).ids)
        return marks[tail]

    def learn(new: set[str]) -> None:
        words, older, letters = held["words"], held["older"], held["letters"]
        again = set(filter(older.__contains__, new))  # intersection with a dictionary walks all of it
        words.update(zip(again, map(older.__getitem__, again), strict=True))
        fresh = list(new.difference(again))
        bodies = [w.rstrip(MARKS) for w in fresh]
        plain = [ranks is not None and b.isalpha() and (b.isascii() or max(b) < LATIN) for b in bodies]
        rest = [w for w, p in zip(fresh, plain, strict=True) if not p]
        if rest:
            found = tokenizer.encode_batch_fast(rest, add_special_tokens=False)
            words.update((w, packed(e.ids)) for w, e in zip(rest, found, strict=True))
            fresh, bodies = list(compress(fresh, plain)), list(compress(bodies, plain))
        if len(letters) > cached:
            letters = held["letters"] = {}
        lows = [b.lower() for b in bodies]
        unknown = list(set(lows).difference(letters))
        if unknown:
            ids = np.array(ranks.encode_ordinary(END.join(unknown) + END), "<u4")
            at = [0, *((np.flatnonzero(ends[ids]) + 1) * 4).tolist()]  # a word's last id says that it ends
            body = ids.tobytes()
            letters.update(zip(unknown, [body[i:j] for i, j in pairwise(at)], strict=True))
        bare = list(map(eq, fresh, bodies))
        words.update(zip(compress(fresh, bare), map(letters.__getitem__, compress(lows, bare)), strict=True))
        words.update((w, letters[low] + marked(w[len(b) :])) for w, b, low, same in zip(fresh, bodies, lows, bare, strict=True) if not same)

    def encode(texts: list[str]) -> list[bytes]:
        chunks = [t.replace("\n", " ").split(" ") for t in texts]
        asked = set().union(*chunks)
        missing = asked.difference(held["words"])
        if missing and len(held["words"]) + len(missing) > cached // 2:
            held["older"], held["words"] = held["words"], {}
            missing = asked
        if missing:
            learn(missing)
        get = held["words"].__getitem__
        return [b"".join(map(get, row)) for row in chunks]

    return encode


def token_pieces(
    docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, text: str = "text", cached: int = CACHED_WORDS
) -> DataFrame:
    """One row per piece: whole windows and a document's remainder.  Null texts are empty: one piece, the closing id.

    ``piece_key`` is unique: the number of the Spark task and of the piece in it.  It is stored with the
    pieces before anything relies on it, so a task that runs again cannot change it afterwards.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = word_encoder(tokenizer_path, cached)
        closing = np.array([end_id], "<u4").tobytes()
        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for low in range(0, len(ids), 64):  # few texts at a time, as some are very long
                out: list[tuple] = []
                part = [t or "" for t in texts.slice(low, 64).to_pylist()]
                for doc, body in zip(ids[low : low + 64], encode(part), strict=True):
                    body += closing
                    total = len(body) // 4
                    for start in range(0, total, window):
                        piece = body[4 * start : 4 * (start + window)]
                        out.append((doc, start, len(piece) // 4, zlib.crc32(piece), total, key))
                        key += 1
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece_key"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


def fill(room: int, counts: dict[int, int]) -> dict[int, int]:
    """How many of each length to take so that their sum is as close to ``room`` as can be, from below.

    ``counts`` maps lengths to how many there are, longest first.  Bit s of ``reach`` says that s can be
    summed up; counts are split into powers of two, so a length takes few steps.
    """
    reach, mask = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for length, count in counts.items():
        if length > room:
            continue
        left, step = min(count, room // length), 1
        while left:
            take = min(step, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left, step = left - take, step * 2
        if reach >> room:
            break
    best, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if best == 0:
            break
        if not before >> best & 1:
            chosen[length] = chosen.get(length, 0) + take
            best -= length * take
    return chosen


def minimum_slack(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The window number and the offset of each of ``lengths``, none of which is above ``window``."""
    order = np.argsort(-lengths, kind="stable")
    rows: dict[int, list[int]] = {}
    for i in order[::-1].tolist():
        rows.setdefault(int(lengths[i]), []).append(i)
    counts = {n: len(rows[n]) for n in sorted(rows, reverse=True)}
    bins, offsets, number = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    while counts:
        first = next(iter(counts))
        chosen = {first: 1}
        counts[first] -= 1
        if not counts[first]:
            del counts[first]
        for n, k in fill(window - first, counts).items():
            chosen[n] = chosen.get(n, 0) + k
            counts[n] -= k
            if not counts[n]:
                del counts[n]
        at = 0
        for n, k in chosen.items():
            for _ in range(k):
                i = rows[n].pop()
                bins[i], offsets[i] = number, at
                at += n
        number += 1
    return bins, offsets


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    group_rows: int = GROUP_ROWS,
    text: str = "text",
    cached: int = CACHED_WORDS,
) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document lies in exactly one piece.  Repeated rows are documents of their own.
    A null doc_id stays null, and its documents are packed like others.  An empty table gives no pieces.  Groups differ in size by chance only, as they are dealt by a hash
    of the piece's key; a window that cannot be filled is the last of its group.  ``cached`` bounds the words that a worker keeps.
    """
    pieces = stored(token_pieces(docs, tokenizer_path, window, end_id, text, cached), "pieces")
    rest = pieces.where(F.col("length") < window)
    groups = max(1, -(-rest.count() // group_rows))

    def pack_group(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece_key")
        bins, offsets = minimum_slack(table["length"].to_numpy(), window)
        group = table["group"][0].as_py()
        # whole windows have even numbers, packed windows odd ones
        sequence = pa.array((((np.int64(group) << 36) + bins) << 1) + 1, pa.int64())
        kept = table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return kept.append_column("sequence_id", sequence).append_column("offset", pa.array(offsets, pa.int64()))

    packed = (
        rest.withColumn("group", F.pmod(F.xxhash64("piece_key"), F.lit(groups)).cast("int"))
        .groupBy("group")
        .applyInArrow(pack_group, PACKED)
    )
    whole = pieces.where(F.col("length") == window).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("piece_key") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return whole.unionByName(packed)
