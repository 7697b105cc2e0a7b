"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a pre-token there is exactly one token that its BPE encoding
ends with. An Aho-Corasick automaton over the vocabulary lists the tokens that
end at each position; a candidate is the right one if the encoding of the
prefix before it ends with a token the candidate may follow. Whether token b
may follow token a is decided by undoing the merges of both across the
boundary: if a merge over the boundary would have been made before the merges
undone so far, they can't stand side by side. Following the stored tokens back
from the end gives exactly the ids that applying the merges in order gives.

Texts are cut at single spaces before other characters, where the pre-token
pattern always cuts too, so pieces repeat and are encoded once; texts with
longer blank runs are cut by the pattern as a whole. Added tokens of the
vocabulary file that occur in a text become their ids. Decoding concatenates
the bytes of the tokens. Rows stream in Arrow batches and nothing is shuffled.

Defined results: a null text counts as empty and has no ids; ids are stored as
little-endian unsigned 32-bit integers; null ids decode to the empty string.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallygrove.llm.arrow import give_back, slices
from tallygrove.session import text_batches

#: Fixed value: the pre-token pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries of one generation of the cache of ids; a Python worker holds two while it encodes.
CACHED = 100_000
#: Characters up to which a piece is worth caching.
SHORT = 48

_LONG_BLANKS = re.compile(r" \s|[^\S ] ")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Recent:
    """A cache of two generations: what isn't asked for in a while is forgotten."""

    def __init__(self, most: int = CACHED):
        self.new, self.old, self.most = {}, {}, most

    def get(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value


class PrefixBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        vocab: dict[str, int] = data["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        self.cut = regex.compile(PATTERN).findall
        letters = byte_letters()
        back = {s: b for b, s in enumerate(letters)}

        # Ranks: single letters first, then merges in their order.
        names = list(letters)
        rank = {s: r for r, s in enumerate(names)}
        self.left, self.right = list(range(256)), list(range(256))
        self.joined: dict[tuple[int, int], int] = {}
        for a, b in merges:
            r = rank.setdefault(a + b, len(names))
            if r == len(names):
                names.append(a + b)
                self.left.append(rank[a])
                self.right.append(rank[b])
            self.joined.setdefault((rank[a], rank[b]), r)
        self.ids = [vocab[s] for s in names]
        self.length = [len(s) for s in names]
        self.machine = ahocorasick.Automaton()
        for r, s in enumerate(names):  # over bytes as letters of the same number
            self.machine.add_word("".join([chr(back[c]) for c in s]), r)
        self.machine.make_automaton()

        self.bytes_of: dict[int, bytes] = {vocab[s]: bytes(back[c] for c in s) for s in vocab if all(c in back for c in s)}
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.split_added = (
            re.compile("(" + "|".join(re.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")").split
            if self.added
            else None
        )
        self.forget()

    def forget(self) -> None:
        """Empty the caches. A pre-token that stands alone is cut to itself, so pieces and pre-tokens share one."""
        self.known, self.may_follow = Recent(), {}

    def _follows(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens of ranks a and b side by side."""
        # `before`: merges over the boundary below this rank would have come first.
        before = 1 << 60
        while True:
            over = self.joined.get((a, b))
            if over is not None and over < before:
                return False
            # Undo the later of the two last merges; at equal ranks the left one was made first.
            whole_a, whole_b = a < 256, b < 256
            if whole_a and whole_b:
                return True
            if not whole_a and (whole_b or a > b):
                before, a = a, self.right[a]
            else:
                before, b = b + 1, self.left[b]

    def pretoken(self, raw: str) -> bytes:
        """Ids of one pre-token."""
        found = self.known.get(raw)
        if found is not None:
            return found
        s = raw.encode("utf-8").decode("latin-1")
        n = len(s)
        last = [-1] * (n + 1)  # the rank that the encoding of s[:i] ends with
        length, pairs = self.length, self.may_follow
        if len(pairs) > 4 * CACHED:
            pairs.clear()
        for end, r in self.machine.iter(s):
            end += 1
            if last[end] < 0:
                start = end - length[r]
                if not start:
                    last[end] = r
                elif (before := last[start]) >= 0:
                    key = before << 20 | r
                    fits = pairs.get(key)
                    if fits is None:
                        fits = pairs[key] = self._follows(before, r)
                    if fits:
                        last[end] = r
        out, at = [], n
        while at:
            r = last[at]
            if r < 0:
                raise ValueError(f"no encoding of {raw[:40]!r}")
            out.append(self.ids[r])
            at -= length[r]
        found = np.array(out[::-1], "<u4").tobytes()
        if n <= SHORT:
            self.known.put(raw, found)
        return found

    def _whole(self, text: str) -> bytes:
        return b"".join([self.pretoken(x) for x in self.cut(text)])

    def _piece(self, piece: str) -> bytes:
        out = self.known.get(piece)
        if out is None:
            out = self._whole(piece)
            if len(piece) <= SHORT and piece not in self.known.new:
                self.known.put(piece, out)
        return out

    def _ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        if _LONG_BLANKS.search(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        known, out = self.known, [self._whole(first)]
        for x in rest:
            x = " " + x
            out.append(known.new.get(x) or self._piece(x))
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.split_added is None or not any(s in text for s in self.added):
            return self._ordinary(text)
        return b"".join(
            np.array([self.added[x]], "<u4").tobytes() if x in self.added else self._ordinary(x)
            for x in self.split_added(text)
        )

    def decode(self, ids: bytes | None) -> str:
        if not ids:
            return ""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> PrefixBPE:
    """One encoder for each Python worker and vocabulary, which outlives a task; its caches don't."""
    return PrefixBPE(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) for each row of docs."""

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for part in slices(batch, "_text", 4 << 20):
                ids = [bpe.encode(t) for t in part["_text"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part["_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["_id", "n_tokens", "ids"],
                )
            give_back()
        # An idle worker stays beside the tasks of other stages.
        bpe.forget()
        give_back()

    text_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return slim.mapInArrow(run, "_id long, n_tokens long, ids binary").withColumnRenamed("_id", id_col)


def decode(coded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """coded with the text of its ids in out_col, which replaces a column of that name."""
    coded = coded.select(*[F.col(f"`{c}`") for c in coded.columns if c.lower() != out_col.lower()])
    names = coded.columns

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for part in slices(batch, ids_col):
                texts = pa.array([bpe.decode(x) for x in part[ids_col].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*names, out_col])

    return coded.mapInArrow(run, StructType([*coded.schema.fields, StructField(out_col, StringType())]))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_prefix_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or vocabulary()
    coded = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


QUERIES = {"op9_prefix_bpe": op9_prefix_bpe}
ORACLES: dict = {}
