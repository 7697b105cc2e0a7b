"""Token-id shards compressed by a Re-Pair grammar.

Documents are range-partitioned and sorted by id, encoded by the tokenizers
library, closed with an end id and cut into blocks of about ``BLOCK_IDS`` ids.
Each block gets its own grammar, made in rounds until no pair of adjacent
symbols occurs at ``LEAST_COUNT`` places. In a round every such pair, the most
frequent first, takes the places that no pair before it took, from left to
right, and becomes a nonterminal; one left with fewer than ``LEAST_USES`` gives
its places back. No place of a pair is left but next to one taken or given back,
so the next round counts only those and still counts every frequent pair. A pair
never holds the end id, so no rule crosses a document.

The file format is a Parquet table of blocks (written by Spark, so a lost task
leaves no half file): part, block, base, first (ids of the part before the
block), n_ids, doc_ids, doc_lengths, rounds (rules made in each round), rules
(all left symbols, then all right ones), lengths (ids that each rule expands to,
uint32), n_symbols and symbols. Symbols below ``base`` are ids; base + i is rule
i. Symbols take as many bits as the block's largest needs: their low 16 bits as
uint16, then a plane of bits for each bit above, so any vocabulary and any number
of rules fits. ``decode_range`` finds a document's symbols from the expansion
lengths and expands only those.

Encoding works on the distinct pieces between blanks, which the vocabulary's
pre-tokenizer never joins; they are encoded by the library in bulk. Other
vocabularies are given whole texts.

Defined results: a null text is a document of one end id; null doc ids come
first; rows that repeat an id follow one another in an order fixed by their
texts; an empty table gives no blocks; further columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.llm.arrow import give_back, slices
from tallygrove.session import small_side, temporary, text_batches

END = 2
BLOCK_IDS = 1 << 20
#: Places of a pair that becomes a rule, and those that it must get.
LEAST_COUNT, LEAST_USES = 6, 3
CACHED = 600_000
#: A Latin letter whose lower case is a letter, then a mark.
LETTER_MARK = r"[A-Za-z\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{012F}\x{0131}-\x{024F}][,.]$"

BLOCKS = (
    "part int, block int, base int, first long, n_ids long, doc_ids array<long>, doc_lengths array<long>, "
    "rounds array<int>, rules binary, lengths binary, n_symbols long, symbols binary"
)


def _by_pieces(config: dict) -> bool:
    """Whether a vocabulary's texts may be cut at blanks, as PieceEncoder does: lower case, any blank as one, letters apart from marks, ends of words marked."""
    blank = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    try:
        split = config["pre_tokenizer"]["pretokenizers"][0]
        return (
            config["normalizer"]["normalizers"] == [{"type": "NFC"}, blank, {"type": "Lowercase"}]
            and split["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
            and (split["type"], split["behavior"], split["invert"]) == ("Split", "Removed", True)
            and [x["type"] for x in config["pre_tokenizer"]["pretokenizers"][1:]] == ["ByteLevel"]
            and (config["model"]["type"], config["model"]["end_of_word_suffix"]) == ("BPE", "</w>")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in config["added_tokens"])
        )
    except (KeyError, TypeError, IndexError):
        return False


class PieceEncoder:
    """Encodes texts piece by piece with the tokenizers library; knows the pieces it has seen.

    Letters alone have one word end each or, where a lower case has a mark, more,
    never none: so a group has as many ends as pieces only if each has one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        marks = [self.library.encode(m, add_special_tokens=False).ids for m in ",."]
        self.marks = np.array([0, *(m[0] for m in marks)], np.uint32)
        self.by_pieces = _by_pieces(json.loads(self.library.to_str())) and all(len(m) == 1 for m in marks)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.mark, self.mark_id = next(iter(self.added.items()), (None, None))
        #: Every added token holds it, so a piece without it holds none.
        self.sign = os.path.commonprefix(list(self.added)) if self.added else ""
        self.ends_word = np.zeros(self.size, bool)
        self.ends_word[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        #: Words seen lately, and those before; what isn't seen again in a while is forgotten.
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _cut(self, group: list[str], raw: bytes, last: np.ndarray, gap: int) -> bool:
        """Store the ids of a group from their joined ids; last: places where a piece ends, gap: ids between pieces."""
        start = 0
        if len(last) != len(group):
            return False
        for piece, end in zip(group, (4 * last).tolist()):
            self.known[piece] = raw[start:end]
            start = end + 4 * gap
        return True

    def _ask(self, pieces: list[str]) -> None:
        """Ids of pieces from the library, many in one text."""
        encode = self.library.encode_batch_fast
        words = [p for p in pieces if p.isalpha()]
        groups = [words[i : i + 1000] for i in range(0, len(words), 1000)]
        plain = [p for p in pieces if not p.isalpha()]
        # Letters alone are one pre-token, whose last id ends a word.
        for group, e in zip(groups, encode([" ".join(g) for g in groups], add_special_tokens=False) if groups else []):
            ids = np.array(e.ids, "<u4")
            if not self._cut(group, ids.tobytes(), np.flatnonzero(self.ends_word[ids]) + 1, 0):
                plain += group
        others = plain if self.mark is None else [p for p in plain if self.sign in p]
        plain = [] if self.mark is None else [p for p in plain if self.sign not in p]
        # Elsewhere an added token stands between the pieces.
        groups = [plain[i : i + 1000] for i in range(0, len(plain), 1000)]
        for group, e in zip(groups, encode([self.mark.join(g) for g in groups], add_special_tokens=False) if groups else []):
            ids = np.array(e.ids, "<u4")
            self._cut(group, ids.tobytes(), np.append(np.flatnonzero(ids == self.mark_id), len(ids)), 1)
        for piece, e in zip(others, encode(others, add_special_tokens=False) if others else []):
            self.known[piece] = np.array(e.ids, "<u4").tobytes()

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        if len(self.known) > CACHED:
            self.known, self.older = {"": b""}, self.known
        found = list(map(self.known.get, words))
        fresh = [w for w, ids in zip(words, found) if ids is None]
        self.known.update((w, self.older[w]) for w in fresh if w in self.older)
        self._ask([w for w in fresh if w not in self.older])
        return [self.known[w] if ids is None else ids for w, ids in zip(words, found)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has). A mark after a letter is a pre-token of its own and case is dropped, so few bare words need the library."""
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if not self.by_pieces:
            found = [e.ids for e in self.library.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64)
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        pieces = pc.list_flatten(lists).dictionary_encode()
        marked = pc.match_substring_regex(pieces.dictionary, LETTER_MARK)
        bare = pc.if_else(marked, pc.utf8_slice_codeunits(pieces.dictionary, 0, -1), pieces.dictionary)
        tails = pc.if_else(marked, pc.if_else(pc.ends_with(pieces.dictionary, ","), 1, 2), 0).to_numpy(zero_copy_only=False)
        words = pc.if_else(pc.string_is_ascii(bare), pc.ascii_lower(bare), bare).dictionary_encode()
        coded = self._ids(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        flat, first = np.frombuffer(b"".join(coded) + bytes(4), "<u4"), np.cumsum(sizes) - sizes
        which = pieces.indices.to_numpy(zero_copy_only=False)
        word, tail = words.indices.to_numpy(zero_copy_only=False)[which], tails[which]
        own = sizes[word] + (tail > 0)
        ends = np.cumsum(own)
        # Where a mark follows, the place after the word's ids is read first and then overwritten.
        out = flat[np.repeat(first[word] - (ends - own), own) + np.arange(int(ends[-1]) if len(ends) else 0)]
        last = np.flatnonzero(tail)
        out[ends[last] - 1] = self.marks[tail[last]]
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return out, np.diff(np.concatenate(([0], ends))[bounds])


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _claim(places: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which of the ascending places pairs take that come one after another in order, each from left to right: two neighbours can't both be taken.

    A place that no neighbour comes before is taken; going away from it, every
    other one is, as long as each comes after the one before; where two such
    ways meet, the last place is taken if both leave it free.
    """
    touch = np.diff(places) == 1
    left_first = order[:-1] <= order[1:]
    here = np.arange(len(places))
    after_left = np.concatenate((np.zeros(min(len(places), 1), bool), touch & left_first))
    after_right = np.concatenate((touch & ~left_first, np.zeros(min(len(places), 1), bool)))
    from_left = here - np.maximum.accumulate(np.where(after_left, 0, here))
    from_right = np.minimum.accumulate(np.where(after_right, len(places), here)[::-1])[::-1] - here
    return (from_left % 2 == 0) & (from_right % 2 == 0)


def _find(code: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of code that hold one of chosen, which one); a table of hashes spares nearly all searches in the sorted chosen."""
    bits = 8 * code.dtype.itemsize
    times = code.dtype.type(2654435761 if bits == 32 else 0x9E3779B97F4A7C15)
    slot = lambda c: (c * times) >> code.dtype.type(bits - 20)
    table = np.full(1 << 20, -1, np.int32)
    table[slot(chosen)] = np.arange(len(chosen), dtype=np.int32)
    which = table[slot(code)]
    at = np.flatnonzero(which >= 0)
    which, code = which[at], code[at]
    hit = chosen[which] == code
    lost = np.flatnonzero(~hit)
    again = np.minimum(np.searchsorted(chosen, code[lost]), len(chosen) - 1)
    which[lost], hit[lost] = again, chosen[again] == code[lost]
    return at[hit], which[hit]


def compress(ids: np.ndarray, base: int, end: int = END) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(symbols, rules, rules made in each round) of a block of ids, all below base."""
    seq = ids.astype(np.uint32)
    rules, rounds, free = [np.empty((0, 2), np.uint32)], [], base
    places = np.flatnonzero((seq[:-1] != end) & (seq[1:] != end)).astype(np.int32)
    while True:
        # Codes of pairs take 32 bits as long as symbols take 16.
        half, wide = (16, np.uint32) if free <= 1 << 16 else (32, np.uint64)
        code = seq[places].astype(wide) << wide(half)
        code |= seq[places + 1]
        ordered = np.sort(code)
        starts = np.flatnonzero(np.concatenate((np.ones(min(len(ordered), 1), bool), ordered[1:] != ordered[:-1])))
        counts = np.diff(np.append(starts, len(ordered)))
        good = np.flatnonzero(counts >= LEAST_COUNT)
        if not len(good):
            return seq, np.concatenate(rules), rounds
        chosen = ordered[starts[good]]
        del ordered
        order = np.empty(len(good), np.int32)
        order[np.argsort(-counts[good], kind="stable")] = np.arange(len(good), dtype=np.int32)
        at, which = _find(code, chosen)
        del code
        at = places[at]
        taken = _claim(at, order[which])
        at, which = at[taken], which[taken]
        made = np.bincount(which, minlength=len(chosen)) >= LEAST_USES
        symbol = (free - 1 + np.cumsum(made)).astype(np.uint32)
        own = made[which]
        back, at, which = at[~own], at[own], which[own]
        look = np.zeros(len(seq) + 1, bool)
        for shift in (-1, 0, 1):
            look[back + shift] = True
        seq[at] = symbol[which]
        look[at] = True
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, look = seq[stay], look[:-1][stay]
        places = np.flatnonzero((look[:-1] | (seq[1:] >= free)) & (seq[:-1] != end) & (seq[1:] != end)).astype(np.int32)
        kept = chosen[made]
        rules.append(np.stack((kept >> wide(half), kept & wide((1 << half) - 1)), axis=1).astype(np.uint32))
        rounds.append(len(kept))
        free += len(kept)


def _joined(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, .. of each start, size of them, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def expand(symbols: np.ndarray, rules: np.ndarray, rounds: list[int], base: int) -> np.ndarray:
    """The ids of symbols. The rules are expanded once, round by round, into one array that symbols are read from."""
    sizes = np.ones(base + len(rules), np.int64)
    starts = np.arange(base + len(rules))
    flat, low, end = np.arange(base, dtype=np.uint32), base, base
    for made in rounds:
        pair = rules[low - base : low - base + made].astype(np.int64)
        parts = sizes[pair]
        sizes[low : low + made] = parts.sum(axis=1)
        starts[low : low + made] = end + np.cumsum(sizes[low : low + made]) - sizes[low : low + made]
        flat = np.concatenate((flat, flat[_joined(starts[pair].ravel(), parts.ravel())]))
        low, end = low + made, len(flat)
    return flat[_joined(starts[symbols], sizes[symbols])]


def expansion_lengths(rules: np.ndarray, rounds: list[int], base: int) -> np.ndarray:
    """Ids that each rule stands for."""
    sizes = np.ones(base + len(rules), np.uint32)
    low = base
    for made in rounds:
        part = rules[low - base : low - base + made]
        sizes[low : low + made] = sizes[part[:, 0]] + sizes[part[:, 1]]
        low += made
    return sizes[base:]


def pack(symbols: np.ndarray, width: int) -> bytes:
    """The low 16 bits of each symbol, then planes of the bits above, up to width."""
    planes = [np.packbits((symbols >> np.uint32(b)) & np.uint32(1)) for b in range(16, width)]
    return b"".join([symbols.astype("<u2").tobytes(), *(p.tobytes() for p in planes)])


def unpack(raw: bytes, n: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Symbols lo to hi of the n that pack() stored."""
    hi = n if hi is None else hi
    out = np.frombuffer(raw, "<u2", hi - lo, 2 * lo).astype(np.uint32)
    step, plane = -(-n // 8), 2 * n
    for b in range(16, 16 + ((len(raw) - plane) // step if n else 0)):
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, -(-hi // 8) - lo // 8, plane + lo // 8))
        out |= bits[lo % 8 : lo % 8 + hi - lo].astype(np.uint32) << np.uint32(b)
        plane += step
    return out


def _rules(block: dict) -> np.ndarray:
    return unpack(block["rules"], 2 * sum(block["rounds"])).reshape(2, -1).T


def decode_block(block: dict) -> np.ndarray:
    """All ids of a block (a row of the shard table)."""
    return expand(unpack(block["symbols"], block["n_symbols"]), _rules(block), block["rounds"], block["base"])


def decode_range(block: dict, start: int, n: int) -> np.ndarray:
    """n ids from place start of a block, expanding only the symbols that cover them."""
    rules, base = _rules(block), block["base"]
    symbols = unpack(block["symbols"], block["n_symbols"])
    sizes = np.concatenate((np.ones(base, np.uint32), np.frombuffer(block["lengths"], "<u4")))
    ends = np.cumsum(sizes[symbols], dtype=np.int64)
    lo, hi = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + n, "left") + 1
    skip = start - (int(ends[lo - 1]) if lo else 0)
    seq = symbols[lo:hi]
    while len(at := np.flatnonzero(seq >= base)):
        places = np.arange(len(seq)) + np.cumsum(seq >= base) - (seq >= base)
        out = np.empty(len(seq) + len(at), np.uint32)
        out[places] = seq
        out[places[at]], out[places[at] + 1] = rules[seq[at] - base].T
        seq = out
    return seq[skip : skip + n]


def _block(part: int, block: int, base: int, first: int, doc_ids: list, lengths: list, parts: list[np.ndarray]) -> pa.RecordBatch:
    ids = np.concatenate(parts)
    give_back()
    symbols, rules, rounds = compress(ids, base)
    width = (base + len(rules) - 1).bit_length()
    values = [
        part, block, base, first, len(ids), doc_ids, lengths, rounds, pack(rules.T.ravel(), width),
        expansion_lengths(rules, rounds, base).astype("<u4").tobytes(), len(symbols), pack(symbols, width),
    ]
    types = [
        pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()),
        pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64(), pa.binary(),
    ]
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)


def write_shards(
    docs: DataFrame, path: str, out_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> str:
    """Encode docs and write the shard table; returns its folder."""
    spark = docs.sparkSession
    out_dir = out_dir or temporary(spark, "token-shards")

    def run(batches):
        from pyspark import TaskContext

        part, block, base, first = TaskContext.get().partitionId(), 0, encoder(path).size, 0
        doc_ids, lengths, parts, held = [], [], [], 0
        for batch in batches:
            for piece in slices(batch, "_text", 4 << 20):
                ids, sizes = encoder(path).encode(piece["_text"])
                ends = np.cumsum(sizes)
                ids, sizes = np.insert(ids, ends, END), sizes + 1
                ends, start, names = np.cumsum(sizes), 0, piece["_id"].to_pylist()
                lo = 0
                # A block ends with the document that fills it.
                while lo < len(names):
                    hi = min(int(np.searchsorted(ends, start + BLOCK_IDS - held)) + 1, len(names))
                    doc_ids += names[lo:hi]
                    lengths += sizes[lo:hi].tolist()
                    parts.append(ids[start : ends[hi - 1]])
                    held += len(parts[-1])
                    start, lo = int(ends[hi - 1]), hi
                    if held >= BLOCK_IDS:
                        yield _block(part, block, base, first, doc_ids, lengths, parts)
                        block, first, doc_ids, lengths, parts, held = block + 1, first + held, [], [], [], 0
        if doc_ids:
            yield _block(part, block, base, first, doc_ids, lengths, parts)

    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    text_batches(spark)
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A hash and the row's place part rows that repeat an id.
    slim = slim.withColumns({"_hash": F.xxhash64("_text"), "_row": F.monotonically_increasing_id()})
    ordered = slim.repartitionByRange(count, "_id", "_hash", "_row").sortWithinPartitions("_id", "_hash", "_text")
    ordered.select("_id", "_text").mapInArrow(run, BLOCKS).write.parquet(out_dir)
    return out_dir


def read_shards(spark, out_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a shard table, in its files' order."""
    blocks = spark.read.schema(BLOCKS).parquet(out_dir)
    # One row for each part, of which there are as many as partitions of the writer.
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = blocks.join(small_side(starts), F.col("part") == F.col("_p"))

    def run(batches):
        for row in (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(batch.num_rows)):
            ids = decode_block(row).astype("<u4")
            sizes = np.array(row["doc_lengths"], np.int64)
            ends = np.cumsum(sizes)
            raw = ids.tobytes()
            cut = [raw[4 * (b - n) : 4 * b] for n, b in zip(sizes.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(ends - sizes + row["_before"] + row["first"], pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(cut, pa.binary()),
                    pa.array(map(zlib.crc32, cut), pa.int64()),
                ],
                ["doc_id", "start", "n_tokens", "ids", "crc32"],
            )

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary, crc32 long")


def op8_repair(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    out_dir = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_shards(spark, out_dir).select("doc_id", "start", "n_tokens", F.col("crc32").alias("ids_crc32"))


QUERIES = {"op8_repair": op8_repair}
ORACLES: dict = {}
