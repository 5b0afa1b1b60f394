"""Token-id files with Re-Pair grammar compression.

Documents are dealt to ranges of ascending doc_id and sorted; each task encodes its range as a stream
and closes a shard when SHARD_TOKENS ids have gathered. In a shard frequent pairs of neighbouring
symbols are replaced by nonterminals, round after round: each takes the most frequent pairs, down to
1/ROUND_SPAN of the highest count; of overlapping occurrences the more frequent pair's is replaced.
It ends when no pair is frequent or the symbols are used up. Pairs without an occurrence make no rule.
Pairs never cross the end of a document.

File format. Shards are rows of a Parquet table in the shared folder (part, seq, n_docs, n_tokens,
payload), so Spark's commit keeps it whole when executors are lost. A payload holds, little-endian:
MAGIC, then six unsigned 32-bit numbers (documents, ids, terminals, rules, symbols, bytes of a
symbol), doc_ids (64 bits, and a bit each that is 0 for null), ids and symbols of each document (32 bits), rules as
pairs of symbols and their expansion lengths (32 bits), the symbols, and a crc32 of all before. With
the expansion lengths any range of ids is found and expanded by itself (ids_at).

Each document's ids end with END. Null texts count as empty ones: END alone. Null doc_ids come
first; rows with equal doc_id are ordered by a hash of their texts. Empty tables give empty files.
Extra columns are not read.

Encoding. Ids depend on the pre-token alone. Texts are cut into pre-tokens as arrays of code points;
every worker keeps the ids of those met, and new ones go through the tokenizers library together.
Texts that contain a special token go through it whole.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.arrays import END_CODE, Store, codes_of, spread
from tidemark.llm.common import kept_by_worker, shared_folder, table

END = 0
SHARD_TOKENS = 2_000_000
#: Rules of a round at most, counts of its pairs against the highest (1/ROUND_SPAN at least), and
#: occurrences that make a pair frequent.
ROUND_RULES, ROUND_SPAN, FREQUENT = 5_000, 64, 16
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
#: Rows that are read from a batch at a time.
BATCH = 64
MAGIC = b"TKRP2\0"
#: Pre-tokens that a worker keeps, their characters, and characters of texts that are encoded together.
KEEP, KEEP_CHARS, BATCH_CHARS = 600_000, 12_000_000, 1 << 20

#: Byte-level characters: printable bytes stand for themselves, the others for those from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: b for b in PRINTABLE} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in PRINTABLE)}
LINE_END = chr(BYTE_LEVEL[10])
#: Byte-level characters of pre-tokens a line each; between them comes a line with a line end's own character.
AS_LINES = BYTE_LEVEL | {10: f"\n{LINE_END}\n"}
#: Stands for a text's end among pre-tokens (which never hold both kinds of characters).
END_MARK = "a!"
#: Kinds of characters; those not met so far are UNKNOWN.
GAP, LETTER, DIGIT, SIGN, TEXT_END, UNKNOWN = range(6)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts by the tokenizers library, with a store of the pre-tokens met."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.model, self.lines = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.lines.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.line_end = self.lines.token_to_id(LINE_END)
        self.vocabulary = self.model.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.kinds = np.full(END_CODE + 1, UNKNOWN, np.uint8)
        self.kinds[[ord("\n"), END_CODE]] = GAP, TEXT_END
        self.store = Store(self.dtype, KEEP, KEEP_CHARS)

    def kinds_of(self, codes: np.ndarray) -> np.ndarray:
        """Kinds of characters; of new ones the library tells with which others they form a pre-token."""
        kinds = self.kinds[codes]
        if len(at := np.flatnonzero(kinds == UNKNOWN)):
            new = np.unique(codes[at])
            self.kinds[new] = GAP
            for lead, kind in (("a", LETTER), ("1", DIGIT), ("!", SIGN)):
                spans = {x for _, x in self.model.pre_tokenizer.pre_tokenize_str("\n".join(lead + chr(c) for c in new.tolist()))}
                self.kinds[new[[(3 * k, 3 * k + 2) in spans for k in range(len(new))]]] = kind
            kinds = self.kinds[codes]
        return kinds

    def starts(self, codes: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin: runs of letters, of digits and of signs, each with a space before it;
        contractions after a lone apostrophe; the rest of gaps, whose last character stands alone before a run."""
        kinds = self.kinds_of(codes)
        runs = np.flatnonzero(np.append(True, (kinds[1:] != kinds[:-1]) | (kinds[1:] == TEXT_END)))
        kind, after = kinds[runs], np.append(runs[1:], len(codes))
        begins = np.zeros(len(codes), bool)
        begins[runs] = True
        gaps = np.flatnonzero((kind[:-1] == GAP) & (kind[1:] != TEXT_END))
        begins[after[gaps] - 1] = True
        begins[after[gaps[codes[after[gaps] - 1] == 32]]] = False
        lone = np.flatnonzero((kind[:-1] == SIGN) & (codes[runs[:-1]] == ord("'")) & (after[:-1] - runs[:-1] == 1) & (kind[1:] == LETTER) & begins[runs[:-1]])
        at = after[lone]  # the letters behind the apostrophe; a text's end follows in any case
        one, two = codes[at], codes[np.minimum(at + 1, len(codes) - 1)]
        size = np.where(np.isin(one, list(map(ord, "stmd"))), 1, 0)
        for x, y in ("re", "ve", "ll"):
            size[(one == ord(x)) & (two == ord(y))] = 2
        begins[at[size > 0]] = False
        begins[(at + size)[size > 0]] = True
        return np.flatnonzero(begins)

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of pre-tokens, END for END_MARK: in one call of the library, as lines of byte-level characters
        with line ends between them; those that hold line ends themselves one by one."""
        counts = np.zeros(len(words), np.int64)
        single = [k for k, w in enumerate(words) if "\n" in w or w == END_MARK]
        others = np.delete(np.arange(len(words)), single)
        rest = [w for w in words if "\n" not in w and w != END_MARK] if single else words
        lines = "\n".join(rest).encode("utf-8", "surrogatepass").decode("latin-1").translate(AS_LINES)
        ids = np.array(self.lines.encode_batch_fast([lines], add_special_tokens=False)[0].ids, self.dtype)
        between = np.flatnonzero(ids == self.line_end)
        if len(between) == len(rest) - 1:
            counts[others] = np.diff(between, prepend=-1, append=len(ids)) - 1
            ids = ids[ids != self.line_end]
        else:  # nothing to encode, or a model without an id of its own for line ends
            single, others, ids = [*range(len(words))], others[:0], ids[:0]
        alone = {k: np.array([END] if words[k] == END_MARK else self.model.encode(words[k], add_special_tokens=False).ids, self.dtype) for k in single}
        counts[single] = [len(x) for x in alone.values()]
        begins = np.cumsum(counts) - counts
        out = np.zeros(counts.sum(), self.dtype)
        out[spread(begins[others], counts[others])] = ids
        for k, x in alone.items():
            out[begins[k] : begins[k] + len(x)] = x
        return out, counts

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, END included."""
        texts = [t or "" for t in texts]
        whole = {k: t for k, t in enumerate(texts) if any(x in t for x in self.special)}
        plain = ["" if k in whole else t for k, t in enumerate(texts)] if whole else texts
        if not plain:
            return []
        codes, ends = codes_of(plain)
        starts = self.starts(codes)

        def learn(at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            everything = codes[spread(at, sizes)]
            everything[is_end := everything == END_CODE] = 0
            joined, stops = everything.tobytes().decode("utf-32-le", "surrogatepass"), np.cumsum(sizes)
            words = [joined[a:b] for a, b in zip((stops - sizes).tolist(), stops.tolist(), strict=True)]
            if is_end.any():
                words[int(np.flatnonzero(codes[at] == END_CODE)[0])] = END_MARK
            return self.learn(words)

        ids, counts = self.store.numbers(self.store.entries(codes, starts, learn))
        stops = np.cumsum(counts)[np.searchsorted(starts, ends)]
        out = [ids[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
        for k, text in whole.items():
            out[k] = np.array([*self.model.encode(text, add_special_tokens=False).ids, END], self.dtype)
        return out


def encoder_of(path: str) -> Encoder:
    """One encoder for each worker and model, with its store."""
    return kept_by_worker(("tokenfile", path), lambda: Encoder(path))


def compress(ids: np.ndarray, ends: np.ndarray, terminals: int, symbols: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, ends, rules): Re-Pair of the ids, where ends marks the last id of each document.

    Of two symbols each below `symbols`, a pair is one 32-bit number; larger vocabularies use 64 bits.
    Only pairs that were frequent before or hold a new symbol can be frequent, so only these are counted again."""
    symbols = max(symbols, 1 << (terminals + 4096).bit_length())
    wide = np.uint32 if symbols <= 1 << 16 else np.uint64
    shift = wide(16 if wide is np.uint32 else 32)
    s, e, rules = ids.astype(np.uint32), ends.copy(), np.zeros(0, wide)
    maybe, newest = None, terminals
    while len(s) > 1 and (room := min(ROUND_RULES, symbols - terminals - len(rules))) > 0:
        pairs = s[:-1].astype(wide)
        pairs <<= shift
        pairs |= s[1:]
        able = ~e[:-1]
        if maybe is not None:
            new = s >= newest
            able &= maybe[slot(pairs)] | new[:-1] | new[1:]
        at = np.flatnonzero(able)
        pairs = pairs[at]
        ordered = np.sort(pairs)
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.diff(np.append(first, len(ordered)))
        often = np.flatnonzero(counts >= FREQUENT) if len(ordered) else []
        if not len(often):
            break
        frequent, counts = ordered[first[often]], counts[often]
        maybe = np.zeros(SLOTS, bool)
        maybe[slot(frequent)] = True
        chosen = frequent[np.lexsort((frequent, -counts))[: min(room, int((counts >= counts.max() // ROUND_SPAN).sum()))]]
        chosen = chosen[np.sort(np.unique(slot(chosen), return_index=True)[1])]  # of pairs with one slot, the others wait for the next round
        slots = np.zeros(SLOTS, np.uint16)
        slots[slot(chosen)] = np.arange(len(chosen), dtype=np.uint16)
        rank = slots[slot(pairs)]
        hit = chosen[rank] == pairs
        at, rank = without_overlap(at[hit], rank[hit].astype(np.int64))
        used = np.flatnonzero(np.bincount(rank, minlength=len(chosen)))
        number = np.zeros(len(chosen), np.uint32)
        newest = terminals + len(rules)
        number[used] = newest + np.arange(len(used))
        s[at], e[at] = number[rank], e[at + 1]
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s, e, rules = s[keep], e[keep], np.concatenate((rules, chosen[used]))
    return s, e, np.stack((rules >> shift, rules & ((wide(1) << shift) - wide(1))), 1).astype(np.uint32)


def without_overlap(at: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places at (ascending) whose pairs are replaced, with their ranks: of neighbours the better rank, of
    equal pairs in a row every other from the left; again among those that lost to none of the taken."""
    run = np.maximum.accumulate(np.where((np.diff(at, prepend=-2) != 1) | (np.diff(rank, prepend=-1) != 0), np.arange(len(at)), 0))
    even = (np.arange(len(at)) - run) % 2 == 0
    at, rank = at[even], rank[even]
    taken, ranks = [], []
    while len(at):
        near, first = np.diff(at) == 1, rank[:-1] <= rank[1:]
        left = np.zeros(len(at), bool)
        left[1:] |= near & first
        left[:-1] |= near & ~first
        taken.append(at[~left])
        ranks.append(rank[~left])
        beside = np.append(near & ~left[:-1], False), np.append(False, near & ~left[1:])
        left[1:] &= ~beside[0][:-1]
        left[:-1] &= ~beside[1][1:]
        at, rank = at[left], rank[left]
    return (np.concatenate(taken), np.concatenate(ranks)) if taken else (at, rank)


def slot(pairs: np.ndarray) -> np.ndarray:
    """A place from 0 to SLOTS for each pair."""
    kind = pairs.dtype.type
    mixed = pairs * kind(2654435761 if kind is np.uint32 else 0x9E3779B97F4A7C15)
    mixed >>= kind(8 * pairs.itemsize - SLOT_BITS)
    return mixed.astype(np.intp)


def lengths_of(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Expansion lengths of the rules; a rule only uses earlier ones."""
    out = np.zeros(len(rules), np.uint32)
    done = 0
    while done < len(rules):
        inner = rules[done:].astype(np.int64) - terminals
        ready = int(np.argmax(np.append((inner >= done).any(1), True)))
        part = inner[:ready]
        out[done : done + ready] = np.where(part >= 0, out[np.maximum(part, 0)], 1).sum(1)
        done += ready
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    """The ids that symbols stand for."""
    s = symbols.astype(np.uint32)
    while len(inner := np.flatnonzero(s >= terminals)):
        pair = rules[s[inner] - terminals]
        size = np.ones(len(s), np.int64)
        size[inner] = 2
        at = np.cumsum(size) - size
        out = np.empty(len(s) + len(inner), np.uint32)
        out[at] = s
        out[at[inner]], out[at[inner] + 1] = pair[:, 0], pair[:, 1]
        s = out
    return s


def pack(doc_ids: list[int | None], texts: list[np.ndarray], terminals: int) -> bytes:
    """The payload of a shard."""
    ids = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
    sizes = np.array([len(t) for t in texts], np.uint32)
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum(sizes, dtype=np.int64) - 1] = True
    s, e, rules = compress(ids, ends, terminals)
    own = np.diff(np.flatnonzero(e), prepend=-1).astype("<u4")
    width = 2 if terminals + len(rules) <= 1 << 16 else 4
    body = MAGIC + struct.pack("<6I", len(texts), len(ids), terminals, len(rules), len(s), width)
    body += np.array([i or 0 for i in doc_ids], "<i8").tobytes() + np.packbits([i is not None for i in doc_ids]).tobytes() + sizes.astype("<u4").tobytes() + own.tobytes()
    body += rules.astype("<u4").tobytes() + lengths_of(rules, terminals).astype("<u4").tobytes() + s.astype("<u2" if width == 2 else "<u4").tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """A payload, opened."""

    def __init__(self, payload: bytes) -> None:
        if payload[: len(MAGIC)] != MAGIC or zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
            raise ValueError("not a whole shard")
        docs, self.n_ids, self.terminals, rules, symbols, width = struct.unpack_from("<6I", payload, len(MAGIC))
        at = len(MAGIC) + 24

        def read(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, known = read("<i8", docs), read("u1", (docs + 7) // 8)
        self.known = np.unpackbits(known, count=docs).astype(bool)
        self.sizes, self.own = read("<u4", docs), read("<u4", docs)
        self.rules, self.lengths = read("<u4", 2 * rules).reshape(-1, 2), read("<u4", rules)
        self.symbols = read("<u2" if width == 2 else "<u4", symbols)

    def ids(self) -> np.ndarray:
        """All ids: each symbol's expansion is copied from one table of all expansions."""
        table_ = np.concatenate((np.arange(self.terminals, dtype=np.uint32), expand(np.arange(self.terminals, self.terminals + len(self.rules)), self.rules, self.terminals)))
        sizes = np.concatenate((np.ones(self.terminals, np.int64), self.lengths.astype(np.int64)))
        begins = np.cumsum(sizes) - sizes
        size = sizes[self.symbols]
        ends = np.cumsum(size)
        return table_[np.repeat(begins[self.symbols] - ends + size, size) + np.arange(self.n_ids)]

    def ids_at(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard; only the symbols that cover them are expanded."""
        sizes = np.where(self.symbols >= self.terminals, self.lengths[np.maximum(self.symbols.astype(np.int64) - self.terminals, 0)] if len(self.lengths) else 1, 1)
        ends = np.cumsum(sizes)
        first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
        before = int(ends[first - 1]) if first else 0
        return expand(self.symbols[first : last + 1], self.rules, self.terminals)[start - before : stop - before]


SHARDS = "part int, seq int, n_docs int, n_tokens long, payload binary"


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the documents' ids to folder, in ascending order of their ids."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = encoder_of(path), TaskContext.get().partitionId(), 0
        ids, texts, n = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal ids, texts, n, seq
            row = {"part": part, "seq": seq, "n_docs": len(ids), "n_tokens": n, "payload": pack(ids, texts, encoder.vocabulary)}
            ids, texts, n, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("payload", pa.binary())]))

        def add(names: list[int | None], some: list[str | None]) -> Iterator[pa.RecordBatch]:
            nonlocal n
            for i, found in zip(names, encoder.encode(some), strict=True):
                ids.append(i)
                texts.append(found)
                n += len(found)
                if n >= shard_tokens:
                    yield close()

        for batch in batches:
            names, some, room = [], [], BATCH_CHARS
            for at in range(0, batch.num_rows, BATCH):
                few = batch.slice(at, BATCH)
                names += few.column(0).to_pylist()
                some += (more := few.column(1).to_pylist())
                room -= sum(len(t or "") + 1 for t in more)
                if room <= 0 or at + BATCH >= batch.num_rows:
                    yield from add(names, some)
                    names, some, room = [], [], BATCH_CHARS
        if ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    ordered.select("id", "text").mapInArrow(run, SHARDS).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: start counts the ids of all documents before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, payload in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                shard = Shard(payload)
                ids, ends = shard.ids().astype("<u4"), np.cumsum(shard.sizes, dtype=np.int64)
                begins = ends - shard.sizes
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(crcs)
                names = [i if known else None for i, known in zip(shard.doc_ids.tolist(), shard.known.tolist(), strict=True)]
                columns = [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(names, pa.int64()), pa.array(begins, pa.int64()), pa.array(shard.sizes.astype(np.int64), pa.int64()), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    shards = spark.read.schema(SHARDS).parquet(folder)
    documents = shards.select("part", "seq", "payload").mapInArrow(run, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    sizes = shards.select("part", "seq", "n_tokens")
    # One row for each range of the write: their number is that of its partitions, not of rows.
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("all")).withColumn("skip", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    skips = sizes.select("part", "seq", inside.alias("inside")).join(parts.select("part", "skip"), "part").select("part", "seq", (F.col("inside") + F.col("skip")).alias("before"))
    return documents.join(skips, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op9_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), folder)
    return read(spark, folder)


QUERIES = {"op9_tokenfile": op9_tokenfile}
ORACLES: dict[str, str] = {}
