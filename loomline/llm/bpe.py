"""BPE encoding by tree concatenation, and decoding.

Text is cut at ASCII white space, which no token crosses, and runs are encoded by the tokenizers library, with bounded
caches in each worker; for texts in ASCII and Latin-1 letters the vocabulary's pre-tokenizer is restated here. A run
longer than `leaf` characters is unsplit text: its pre-tokens are halved until they are at most `leaf` characters, the
leaves are encoded by parallel tasks, and neighbours are joined pairwise, level by level: a window of tokens around the
join is encoded again and grows until its first tokens agree with the left side and its last tokens with the right side.
A task gets branches of the tree of halves, of up to `DEALT` characters: a row for each small leaf would cost more than it.

Null text counts as empty; empty text gives no tokens. Repeated rows give repeated rows; null ids stay null. Columns
other than the id and the text are dropped, so clashing names do no harm.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SPACE = "\\x20\\x09-\\x0D"
RUN = re.compile(f"[^{SPACE}]+")
#: The pattern of word_bpe_49k.json's pre-tokenizer, and the same for lower-cased text of PLAIN characters.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile("[\x09-\x0d\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
PLAIN_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\x09-\x0d\x20a-z0-9\xdf-\xf6\xf8-\xff]+")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def pack_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


#: Tokens at each edge of a window that must agree.
AGREE = 2
#: Characters of a branch, the part of a tree that one task gets, unless leaves are longer.
DEALT = 4096
#: Characters of the longest run or word that a cache keeps, so that a bound on their number bounds their room.
KEPT = 48


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """The tokenizer of one worker, with a bounded cache of short encoded runs."""

    def __init__(self, vocabulary: str, leaf: int = 4096, cached: int = 400_000, dealt: int = 0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.vocabulary = vocabulary
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.leaf, self.dealt, self.cached, self.letters = leaf, max(leaf, dealt), cached, byte_letters()
        # two generations of each cache: when the young one is full it becomes the old one, so what is used again stays
        self.cache, self.old_cache, self.words, self.old_words = {}, {}, {}, {}
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        #: Whether the pre-tokenizer is the one restated above.
        self.restated = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0].get("pattern") == {"Regex": WORD_PATTERN} and all(a.startswith("<|") for a in self.special_texts(spec))
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens") or []}
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    @functools.cached_property
    def inner(self):
        """The same merges for text that ends inside a pre-token."""
        from tokenizers.models import BPE

        with open(self.vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return BPE(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])

    @staticmethod
    def special_texts(spec: dict) -> list[str]:
        return [a["content"] for a in spec.get("added_tokens") or []]

    def runs(self, words: list[str]) -> dict[str, bytes]:
        """The runs' ids, encoded where no cache has them."""
        young, old = self.cache, self.old_cache
        wanted = dict.fromkeys(words)
        missing = []
        for w in wanted:
            wanted[w] = young.get(w) or old.get(w)
            if wanted[w] is None:
                missing.append(w)
        for w, e in zip(missing, self.tokenizer.encode_batch(missing, add_special_tokens=False), strict=True) if missing else ():
            wanted[w] = np.asarray(e.ids, dtype="<u4").tobytes()
        young.update((w, ids) for w, ids in wanted.items() if len(w) <= KEPT)
        if len(young) >= self.cached:
            self.cache, self.old_cache = {}, young
        return wanted

    def word(self, word: str) -> bytes:
        """Ids of one lower-cased plain pre-token that the young cache lacks."""
        out = self.old_words.get(word)
        if out is None:
            mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            out = pack_ids([t.id for t in self.tokenizer.model.tokenize(mapped)])
        if len(word) <= KEPT:
            if len(self.words) >= self.cached:
                self.words, self.old_words = {}, self.words
            self.words[word] = out
        return out

    def plain(self, run: str) -> bytes:
        """Ids of one lower-cased plain run that the young cache lacks."""
        out = self.old_cache.get(run)
        if out is None:
            known = self.words.get
            out = b"".join([known(w) or self.word(w) for w in PLAIN_WORD.findall(run)])
        if len(run) <= KEPT:
            if len(self.cache) >= self.cached:
                self.cache, self.old_cache = {}, self.cache
            self.cache[run] = out
        return out

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text whose runs are at most `leaf` characters."""
        if self.restated and "<|" not in text and PLAIN.fullmatch(text):
            known = self.cache.get
            return b"".join([known(w) or self.plain(w) for w in text.lower().split()])
        words = RUN.findall(text)
        try:
            return b"".join(map(self.cache.__getitem__, words))
        except KeyError:
            return b"".join(map(self.runs(words).__getitem__, words))

    def parts(self, text: str) -> Iterator[tuple[bool, bool, bool, object]]:
        """(is a branch, begins a pre-token, ends a pre-token, ids or branch's text) of a text, in order."""
        at, flat = 0, b""
        for m in RUN.finditer(text):
            if m.end() - m.start() <= self.leaf:
                continue
            flat += self.ids(text[at : m.start()])
            at = m.end()
            for is_leaf, first, last, payload in self._long(m.group()):
                if is_leaf:
                    if flat:
                        yield False, True, True, flat
                    flat = b""
                    yield True, first, last, payload
                else:
                    flat += payload
        flat += self.ids(text[at:])
        if flat:
            yield False, True, True, flat

    def _long(self, run: str) -> Iterator[tuple[bool, bool, bool, object]]:
        """The parts of one long run: special tokens, short pre-tokens, and the branches of long ones."""
        one = lambda ids: np.asarray(ids, dtype="<u4").tobytes()
        spans, at = [], 0
        for m in self.special_pattern.finditer(run) if self.special_pattern else ():
            spans += [(False, run[at : m.start()]), (True, m.group())]
            at = m.end()
        for is_special, span in [*spans, (False, run[at:])]:
            if is_special:
                yield False, True, True, one([self.special[span]])
                continue
            if not span:
                continue
            text = self.tokenizer.normalizer.normalize_str(span) if self.tokenizer.normalizer else span
            pieces = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)] if self.tokenizer.pre_tokenizer else [text]
            for piece in pieces:
                if len(piece) <= self.leaf:
                    yield False, True, True, one([t.id for t in self.tokenizer.model.tokenize(piece)])
                else:
                    branches = halves(piece, self.dealt)
                    for i, x in enumerate(branches):
                        yield True, i == 0, i == len(branches) - 1, x

    def piece(self, text: str, ends: bool) -> list[int]:
        """Ids of a part of a pre-token, with or without its end."""
        return [t.id for t in (self.tokenizer.model if ends else self.inner).tokenize(text)] if text else []

    def text_of(self, ids: list[int]) -> str:
        return "".join(map(self.tokenizer.id_to_token, ids))

    def join(self, left: list[int], right: list[int], ends: bool) -> list[int]:
        """Ids of the concatenation of two encoded parts; ends: the right one ends the pre-token."""
        if not left or not right:
            return left or right
        k = 2 * AGREE
        while True:
            a, b = left[-k:], right[:k]
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            text = self.text_of(a + b)
            stop = whole_right and ends
            if stop and self.suffix:
                text = text.removesuffix(self.suffix)
            mid = self.piece(text, stop)
            if (whole_left or mid[:AGREE] == a[:AGREE]) and (whole_right or mid[-AGREE:] == b[-AGREE:]):
                return left[: len(left) - len(a)] + mid + right[len(b) :]
            k *= 2

    def tree(self, leaves: list[list[int]], ends: bool = True) -> list[int]:
        """Joins encoded leaves or branches of one pre-token pairwise, level by level; ends: the last one ends it."""
        while len(leaves) > 1:
            n = len(leaves)
            leaves = [self.join(leaves[i], leaves[i + 1], ends and i + 2 >= n) if i + 1 < n else leaves[i] for i in range(0, n, 2)]
        return leaves[0] if leaves else []

    def branch(self, text: str, ends: bool) -> list[int]:
        """Ids of a branch: its leaves encoded and joined."""
        leaves = halves(text, self.leaf)
        return self.tree([self.piece(x, ends and i == len(leaves) - 1) for i, x in enumerate(leaves)], ends)


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str, leaf: int) -> Encoder:
    """The worker's own encoder: tasks that follow one another in a worker share it."""
    return Encoder(vocabulary, leaf, dealt=DEALT)


@functools.lru_cache(maxsize=2)
def decoder(vocabulary: str):
    """The worker's tokenizer, and its tokens by id where decoding only joins them."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary)
    return tok, [tok.id_to_token(i) for i in range(tok.get_vocab_size())] if tok.decoder is None else None


def halves(text: str, leaf: int) -> list[str]:
    """Leaves of the tree of halves."""
    if len(text) <= leaf:
        return [text]
    mid = len(text) // 2
    return halves(text[:mid], leaf) + halves(text[mid:], leaf)


def _id_type(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, leaf: int = 4096) -> DataFrame:
    """(id, ids): ids as a binary of little-endian unsigned 32-bit integers, one row per row of docs."""
    make = lambda ids, blobs: pa.RecordBatch.from_arrays([ids, pa.array(blobs, pa.binary())], ["id", "ids"])
    return encode_as(docs, make, "ids binary", id_col, text_col, vocabulary, leaf)


def encode_as(docs: DataFrame, make, fields: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, leaf: int = 4096) -> DataFrame:
    """(id, fields): what make(column of ids, encoded texts) gives, in the worker that encodes; make must not need to see
    several slices of rows at once."""
    vocabulary = vocabulary or default_vocabulary()
    kind = _id_type(docs, id_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # not by F.expr: SQL literals lose the pattern's backslashes
    unsplit = (F.length("text") > leaf) & F.col("text").rlike(f"(?:^|[{SPACE}])[^{SPACE}]{{{leaf + 1}}}")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, leaf)
        for b in slices(batches):
            yield make(b.column(0), [enc.ids(t) for t in b.column(1).to_pylist()])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield make(b.column(0), b.column(1).to_pylist())

    schema = f"id {kind}, {fields}"
    encoded = rows.where(~unsplit).mapInArrow(short, schema)
    return encoded.unionByName(_encode_unsplit(rows.where(unsplit), kind, vocabulary, leaf).mapInArrow(joined, schema)).withColumnRenamed("id", id_col)


def _encode_unsplit(rows: DataFrame, kind: str, vocabulary: str, leaf: int) -> DataFrame:
    """The rows that hold long unsplit text: branches are dealt to all tasks, then joined within each document."""
    keyed = rows.groupBy("id", "text").agg(F.count(F.lit(1)).alias("copies")).select("id", F.sha2("text", 256).alias("key"), "copies", "text")
    schema = f"id {kind}, key string, copies long, part int, leaf boolean, first boolean, last boolean, payload binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, leaf)
        for b in slices(batches):
            at, part, found = [], [], []
            for i, text in enumerate(b.column(3).to_pylist()):
                parts = list(enc.parts(text)) or [(False, True, True, b"")]
                at += [i] * len(parts)
                part += range(len(parts))
                found += parts
            flags = [pa.array([p[k] for p in found], pa.bool_()) for k in range(3)]
            payload = pa.array([p[3].encode() if p[0] else p[3] for p in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(at)) for c in b.columns[:3]], pa.array(part, pa.int32()), *flags, payload], ["id", "key", "copies", "part", "leaf", "first", "last", "payload"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, leaf)
        for b in slices(batches):
            out = [
                np.asarray(enc.branch(p.decode(), last), dtype="<u4").tobytes() if is_leaf else p
                for p, is_leaf, last in zip(b.column("payload").to_pylist(), b.column("leaf").to_pylist(), b.column("last").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary())], b.schema.names)

    def assemble(t: pa.Table) -> pa.Table:
        enc = encoder(vocabulary, leaf)
        order = np.argsort(t.column("part").to_numpy())
        payload, is_leaf, first = t.column("payload").to_pylist(), t.column("leaf").to_pylist(), t.column("first").to_pylist()
        out, open_leaves = [], []

        def close() -> None:
            if open_leaves:
                out.append(np.asarray(enc.tree(open_leaves), dtype="<u4").tobytes())
                open_leaves.clear()

        for i in order:
            if not is_leaf[i] or first[i]:
                close()
            if is_leaf[i]:
                open_leaves.append(np.frombuffer(payload[i], dtype="<u4").tolist())
            else:
                out.append(payload[i])
        close()
        return pa.table({"id": t.column("id").slice(0, 1), "copies": t.column("copies").slice(0, 1), "ids": pa.array([b"".join(out)], pa.binary())})

    dealt = keyed.mapInArrow(cut, schema).repartition("id", "key", "part").mapInArrow(leaves, schema)
    whole = dealt.groupBy("id", "key").applyInArrow(assemble, f"id {kind}, copies long, ids binary")
    return whole.select("id", "ids", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("id", "ids")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(id, ids, text): the text that the library's decode(ids, skip_special_tokens=False) gives."""
    vocabulary = vocabulary or default_vocabulary()
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, table = decoder(vocabulary)
        for b in slices(batches):
            out = []
            for ids in b.column(1).to_pylist():
                ids = np.frombuffer(ids or b"", dtype="<u4").tolist()
                out.append(" ".join(map(table.__getitem__, ids)) if table else tok.decode(ids, skip_special_tokens=False))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["id", "ids", "text"])

    out = rows.mapInArrow(texts, f"id {_id_type(encoded, id_col)}, ids binary, text string")
    return out.select(F.col("id").alias(id_col), "ids", "text")


def op8_bpe_encode_decode(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decode(encode(docs)).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def bpe_unsplit_runs(spark, sf_dir: str) -> DataFrame:
    """Every whole text without its white space, signs and digits: one unsplit run each, so that all but the shortest go
    through tree concatenation, with leaves of 64 characters."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}]+", "").alias("text"))
    return decode(encode(docs, leaf=64)).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )


QUERIES = {"op8_bpe_encode_decode": op8_bpe_encode_decode, "bpe_unsplit_runs": bpe_unsplit_runs}
SQL: dict[str, str] = {}
