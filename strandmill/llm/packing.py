"""Packing by power-of-two decomposition.

Each document becomes token ids plus one end id. Its length is split into as
many full sequences as fit and the binary digits of the rest, largest piece
first. A piece of 2**k ids is a whole training sequence of the bucket 2**k, so
no sequence crosses documents and nothing is padded; batches are drawn from one
bucket at a time.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import tidy

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Pieces of one partition get consecutive sequence ids from its number shifted by this.
SEQUENCE_BITS = 40
#: Chunks a worker remembers, the longest of them in bytes, and the length up to
#: which they stay when too many have come again.
REMEMBERED, LONGEST, COMMON = 200_000, 40, 8
#: ASCII signs: fixed values, neither letters, digits nor white space.
SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Normalisers and pre-tokenisers under which words can be encoded one by one: fixed values.
BY_WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
BY_WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Words of letters, in UTF-8, that every such pre-tokeniser keeps whole, and how many are encoded in one text.
LETTERS, TOGETHER = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"), 500
#: Bytes of texts that are encoded at once.
TEXT_BYTES = 2_000_000
#: Ids to a batch of results, so that long documents do not pile up.
BATCH_IDS = 400_000
_encoders: dict[str, "Encoder"] = {}


def split_lengths(total: int, longest: int) -> list[int]:
    """Full sequences first, then the binary digits of the rest, descending."""
    rest = total % longest
    return [longest] * (total // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


class Encoder:
    """UTF-8 text to little-endian ids, as the tokenizer gives them without special tokens
    added; those that stand in the text keep their ids. Bytes that are no UTF-8 count as
    U+FFFD.

    A tokenizer that lower-cases, never joins text across a blank or a line feed, and
    parts a word from ASCII signs that follow it (as its definition tells) has each
    word encoded once, without case and trailing signs, and remembered. Where it also
    marks the last token of a word, words of letters are encoded many at a time. Any
    other tokenizer encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        split = (made["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in made["added_tokens"])
        normal = (made["normalizer"] or {}).get("normalizers") == BY_WORD_NORMALIZERS and made["post_processor"] is None
        self.by_word = plain and normal and split[0].get("pattern") == {"Regex": BY_WORD_PATTERN} and split[0]["behavior"] == "Removed"
        # A blank leads the key of a special token, as no word holds one.
        self.special = {b" " + t["content"].encode(): np.array([t["id"]], "<u4").tobytes() for t in made["added_tokens"]}
        self.marks = re.compile(b"(" + b"|".join(re.escape(key[1:]) for key in sorted(self.special, key=len, reverse=True)) + b")") if self.special else None
        self.known: dict[bytes, bytes] = dict(self.special)
        self.again: set[bytes] = set()
        suffix = made["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool) if suffix and not made["model"].get("dropout") else None
        if self.ends is not None:
            self.ends[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith(suffix)]] = True

    def learn(self, chunks: set[bytes]) -> None:
        """Ids of chunks that are not known yet."""
        known, parts = self.known, {}
        whole = set(filter(LETTERS.fullmatch, chunks)) if self.ends is not None else set()
        wanted = set()
        for chunk in chunks - whole:
            word = chunk.rstrip(SIGNS)
            if word != chunk and word[-1:].isalnum():
                parts[chunk] = word, chunk[len(word) :]
                wanted.update(parts[chunk])
            else:
                wanted.add(chunk)
        wanted = wanted.difference(known)
        if self.ends is not None:
            whole.update(filter(LETTERS.fullmatch, wanted))
            words = list(whole)
            for at in range(0, len(words), TOGETHER):
                self.learn_together(words[at : at + TOGETHER])
            wanted = wanted.union(whole).difference(known)
        fresh = list(wanted)
        for at in range(0, len(fresh), 5000):
            some = fresh[at : at + 5000]
            known |= zip(some, self.encoded(some), strict=True)
        for chunk, (word, signs) in parts.items():
            known[chunk] = known[word] + known[signs]

    def learn_together(self, words: list[bytes]) -> None:
        """Ids of words of letters from one text of them all, if that shows where each ends."""
        ids = np.frombuffer(self.encoded([b" ".join(words)])[0], "<u4")
        cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(cuts) == len(words) and cuts[-1] == ids.nbytes:
            raw, cuts = ids.tobytes(), cuts.tolist()
            self.known |= zip(words, [raw[low:high] for low, high in zip([0, *cuts], cuts, strict=False)], strict=True)

    def encoded(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace") for text in texts], add_special_tokens=False)
        return [np.array(encoding.ids, "<u4").tobytes() for encoding in found]

    def words(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Different words of texts, lower-case, or special tokens with a blank before them;
        which of them follow each other in the texts; and how many a text has."""
        pieces = [self.marks.split(text) if self.marks and self.marks.search(text) else [text] for text in texts]
        plain = [part for parts in pieces for part in parts[::2]]
        line = b" ".join(plain).lower().replace(b"\n", b" ")
        found = pc.split_pattern(pa.array([line], pa.large_binary()), " ").values.dictionary_encode()
        distinct, order = found.dictionary.to_pylist(), found.indices.to_numpy()
        counts = np.array([text.count(b" ") + text.count(b"\n") + 1 for text in plain], np.int64)
        if len(plain) > len(texts):
            marks = [b" " + part for parts in pieces for part in parts[1::2]]
            places = {mark: len(distinct) + i for i, mark in enumerate(dict.fromkeys(marks))}
            distinct += places
            first = np.cumsum([0, *((len(parts) + 1) // 2 for parts in pieces)])
            inner = np.setdiff1d(np.arange(1, len(plain)), first)
            order = np.insert(order, np.cumsum(counts)[inner - 1], [places[mark] for mark in marks])
            counts = np.add.reduceat(counts, first[:-1]) + [len(parts) // 2 for parts in pieces]
        return distinct, order, counts

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word or not texts:
            return self.encoded(texts)
        distinct, order, counts = self.words(texts)
        known = self.known
        fresh = set(distinct).difference(known)
        self.again.update(filter(known.__contains__, distinct))
        self.learn(fresh)
        ids = list(map(known.__getitem__, distinct))
        lengths = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        starts, ids = np.cumsum(lengths, dtype=np.int32) - lengths, np.frombuffer(b"".join(ids), "<u4")
        lengths = lengths[order]
        ends = np.cumsum(lengths, dtype=np.int32)
        places = np.repeat(starts[order] - ends + lengths, lengths)
        places += np.arange(len(places), dtype=np.int32)
        ids = ids.take(places).tobytes()
        cuts = [4 * end for end in ends[np.cumsum(counts) - 1].tolist()]
        for chunk in [chunk for chunk in fresh if len(chunk) > LONGEST]:
            known.pop(chunk, None)
            known.pop(chunk.rstrip(SIGNS), None)
        if len(known) > REMEMBERED:
            self.forget()
        return [ids[low:high] for low, high in zip([0, *cuts], cuts, strict=False)]

    def forget(self) -> None:
        """Remember chunks that came again only, the short ones of those, or none where there are too many of them."""
        kept = self.again if len(self.again) <= REMEMBERED // 2 else [chunk for chunk in self.again if len(chunk) <= COMMON]
        self.known = {chunk: self.known[chunk] for chunk in kept if chunk in self.known} if len(kept) <= REMEMBERED // 2 else {}
        self.known |= self.special
        self.again = set()


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pieces(tokenizer: str, longest: int, end_id: int, id_type: pa.DataType):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << SEQUENCE_BITS
        columns: list[list] = [[] for _ in range(7)]

        def batch() -> pa.RecordBatch:
            types = [id_type, *[pa.int64()] * 5, pa.binary()]
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        held = 0
        for rows in batches:
            sizes, after = np.cumsum(pc.fill_null(pc.binary_length(rows.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
            while after < rows.num_rows:
                at, after = after, max(after + 1, int(np.searchsorted(sizes, TEXT_BYTES + (sizes[after - 1] if after else 0), "right")))
                keys = rows.column(0)[at:after].to_pylist()
                texts = [text or b"" for text in rows.column(1)[at:after].to_pylist()]
                for key, ids in zip(keys, encode(texts), strict=True):
                    ids += end
                    total, start = len(ids) // 4, 0
                    for length in split_lengths(total, longest):
                        piece = ids[4 * start : 4 * (start + length)]
                        for column, value in zip(columns, (key, start, length, total, sequence, 0, piece), strict=True):
                            column.append(value)
                        sequence, start, held = sequence + 1, start + length, held + length
                    if held >= BATCH_IDS:
                        yield batch()
                        columns, held = [[] for _ in range(7)], 0
        if columns[0]:
            yield batch()
        encode.forget()

    return run


def pack(docs: DataFrame, tokenizer: str, longest: int = 4096, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers. A
    piece is a sequence of its own, so ``offset`` is 0 and ``length`` names the
    bucket. ``longest`` must be a power of two. No shuffle takes place.

    ``docs`` should be a stored table: sequence ids follow the order of rows in
    each input partition, which a re-run of a lost task must meet again.

    Null and empty texts give the end id alone, in one piece of length 1.
    Repeated rows and repeated or null ids each get sequences of their own.
    Other columns are ignored; an empty table gives no rows. Long texts are
    streamed piece by piece.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").cast("binary").alias("text"))
    return narrow.mapInArrow(tidy(_pieces(tokenizer, longest, end_id, pa.int64())), SCHEMA)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences as files of one length each: a folder ``length=2**k`` per bucket."""
    pieces.write.partitionBy("length").parquet(path)


def digest(pieces: DataFrame) -> DataFrame:
    """The packing without its ids, but with their checksum."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
