"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Machines compiled from a byte-pair model file, all as arrays:
1. the normaliser: U+2581 becomes a space, one space goes in front;
2. the pieces as a trie of characters, with byte fallback for characters without a piece;
3. the weights: a bigram machine whose state is the last piece. An arc costs 1, and infinity where two
   pieces can't stand side by side, since merging their joint text by score, leftmost first, would merge
   across their border. stands() tells that from the two derivations: it follows the merges on either side
   of the border in their order of time and asks whether a merge across it would come first.
A sequence of pieces is the byte-pair encoding of its text exactly if all its neighbours can stand.

The composition with an input is the lattice of its pieces by place and last piece; the encoding is its
shortest path in the tropical semiring (min, +): arcs are relaxed place by place, and one that can't lower
a place's cost isn't weighed. paths() does so for all new strings of a batch at once, shortest() for one
long string. No arc leads across two characters that no piece holds side by side, so texts fall apart into
short strings there; equal ones have equal paths, which each worker keeps for a while (KEEP). Decoding is the
inverse machine; decoding an encoding returns the text, with U+2581 read as a space.

Null and empty texts have no ids. Repeated rows, null ids and extra columns stay, but for those
with an output's name, which it replaces. The model's path is a parameter and must lead to the file on every
executor.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrays import END_CODE, Store, Table, by_size, codes_of, spread
from tidemark.llm.common import kept_by_worker, others, table

SPACE_MARK = "▁"
#: Strings and pair weights that a worker keeps, characters of both the strings and a batch, and the longest
#: string that paths() takes.
KEEP, KEEP_CHARS, KEEP_PAIRS, BATCH_CHARS, LONG = 300_000, 6_000_000, 400_000, 1 << 19, 48
FAR = np.int32(1 << 30)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Transducer:
    """The compiled machines of one model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = len(model)
        self.text = [model.id_to_piece(i).replace(SPACE_MARK, " ") for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        byte_of = {i: int(self.text[i][3:5], 16) for i in range(n) if model.is_byte(i)}
        self.byte_id = {b: i for i, b in byte_of.items()}
        self.bytes_of = [bytes([byte_of[i]]) if i in byte_of else b"" if special[i] else self.text[i].encode() for i in range(n)]
        self.id = {t: i for i, t in enumerate(self.text) if not special[i] and i not in byte_of}
        self.score = {t: model.get_score(i) for t, i in self.id.items()}
        # Characters within pieces that are no pieces themselves are symbols as well, written as bytes.
        joined = sorted({c for t in self.id if len(t) > 1 for c in t})
        self.symbol = self.id | {c: n + k for k, c in enumerate([c for c in joined if c not in self.id])}
        self.ids_of = [[i] for i in range(n)] + [self.fallback(c) for c in self.symbol if self.symbol[c] >= n]
        self.size = np.array([len(t) for t in self.text] + [1] * (len(self.symbol) - len(self.id)), np.int64)
        self._compile_characters(joined)
        self._compile_trie()
        self._compile_weights()
        self._flat = np.frombuffer(b"".join(self.bytes_of), np.uint8), np.array([len(b) for b in self.bytes_of], np.int64)
        self.store = Store(np.int32, KEEP, KEEP_CHARS)
        self.pairs, self.pair_stands = Table(), np.zeros(0, bool)

    def fallback(self, c: str) -> list[int]:
        return [self.byte_id[b] for b in c.encode("utf-8", "surrogatepass")]

    def _compile_characters(self, joined: list[str]) -> None:
        """Pieces of single characters, and which characters stand side by side in some piece."""
        self.char_piece = np.full(END_CODE + 1, -1, np.int32)
        for t, i in self.id.items():
            if len(t) == 1:
                self.char_piece[ord(t)] = i
        self.char_class = np.zeros(END_CODE + 1, np.uint16)
        self.char_class[list(map(ord, joined))] = np.arange(1, len(joined) + 1)
        self.joins = np.zeros((len(joined) + 1, len(joined) + 1), bool)
        for t in self.id:
            for a, b in zip(t, t[1:], strict=False):
                self.joins[self.char_class[ord(a)], self.char_class[ord(b)]] = True

    def _compile_trie(self) -> None:
        arcs: dict[tuple[int, int], int] = {}
        self.node_piece = [-1]
        for t, i in self.symbol.items():
            node = 0
            for c in t:
                if (node := arcs.setdefault((node, ord(c)), len(self.node_piece))) == len(self.node_piece):
                    self.node_piece.append(-1)
            self.node_piece[node] = i
        self.arcs, self.node_piece = arcs, np.array(self.node_piece, np.int32)
        self.trie = Table(np.array([node << 21 | c for node, c in arcs], np.uint64), np.array([*arcs.values()], np.int32))

    def _compile_weights(self) -> None:
        """Merges on both sides of each symbol's border (symbols from a character up to it, and when each
        is made: the lowest score in its derivation), and the scores of pairs of symbols that merge."""
        self.sound = np.zeros(len(self.size), bool)
        left: list[list] = [[] for _ in self.size]
        right: list[list] = [[] for _ in self.size]
        for t, i in self.symbol.items():
            parts = self.merged(t)
            self.sound[i] = len(parts) == 1
            if len(parts) == 1:
                _, left[i], right[i], _ = parts[0]
        self.left_at, self.left_end, self.left_symbol, self.left_time = self._flat_sides(left)
        self.right_at, self.right_end, self.right_symbol, self.right_time = self._flat_sides(right)
        crossing = {(a, b): self.score[t] for t in self.id for k in range(1, len(t)) if (a := self.symbol.get(t[:k])) is not None and (b := self.symbol.get(t[k:])) is not None}
        self.cross = Table(np.array([a << 32 | b for a, b in crossing], np.uint64), np.arange(len(crossing), dtype=np.int32))
        self.cross_score = np.array([*crossing.values(), -np.inf])  # the last one for those not there

    @staticmethod
    def _flat_sides(sides: list[list]) -> tuple[np.ndarray, ...]:
        sizes = np.array([len(x) for x in sides])
        at = np.cumsum(sizes) - sizes
        flat = [x for side in sides for x in side]
        return at, at + sizes - 1, np.array([x for x, _ in flat], np.int64), np.array([t for _, t in flat] + [0.0])

    def merged(self, text: str) -> list[tuple[str, list, list, float]]:
        """Symbols of a short text after merging by score, leftmost first: each with the symbols that it was
        merged from along its left and right border, and the lowest score so far."""
        own, score = self.symbol, self.score.get
        parts = [(c, [(own.get(c, -1), np.inf)], [(own.get(c, -1), np.inf)], np.inf) for c in text]
        while len(parts) > 1:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                s = score(parts[i][0] + parts[i + 1][0], -np.inf)
                if s > best:
                    best, at = s, i
            if at < 0:
                break
            (a, left, _, ta), (b, _, right, tb) = parts[at], parts[at + 1]
            time = min(best, ta, tb)
            parts[at : at + 2] = [(a + b, [*left, (own[a + b], time)], [*right, (own[a + b], time)], time)]
        return parts

    def stands(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Which of the arcs from the states `before` (last pieces; -1 at the start) to the pieces have a finite weight."""
        out = self.sound[piece].copy()
        live = np.flatnonzero(out & (before >= 0))
        i, j, i_end, j_end = self.right_at[before[live]], self.left_at[piece[live]], self.right_end[before[live]], self.left_end[piece[live]]
        while len(live):
            across = self.cross_score[self.cross.find(self.right_symbol[i].astype(np.uint64) << np.uint64(32) | self.left_symbol[j].astype(np.uint64))]
            time_i, time_j = np.where(i < i_end, self.right_time[i + 1], -np.inf), np.where(j < j_end, self.left_time[j + 1], -np.inf)
            merge = (across > time_i) & (across >= time_j) & (across > -np.inf)  # of equal scores the leftmost merges first
            out[live[merge]] = False
            go = ~merge & ((i < i_end) | (j < j_end))
            left_first = (time_i >= time_j)[go]
            live, i, j, i_end, j_end = live[go], i[go] + left_first, j[go] + ~left_first, i_end[go], j_end[go]
        return out

    def weighed(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """stands(), kept for pairs that were met."""
        if self.pairs.n > KEEP_PAIRS:
            self.pairs, self.pair_stands = Table(), np.zeros(0, bool)
        keys = (before + 1).astype(np.uint64) << np.uint64(32) | piece.astype(np.uint64)
        found = self.pairs.find(keys)
        if len(new := np.flatnonzero(found < 0)):
            own, first, inverse = np.unique(keys[new], return_index=True, return_inverse=True)
            values = np.arange(len(self.pair_stands), len(self.pair_stands) + len(own), dtype=np.int32)
            self.pair_stands = np.concatenate((self.pair_stands, self.stands(before[new[first]], piece[new[first]])))
            self.pairs.add(own, values)
            found[new] = values[inverse]
        return self.pair_stands[found]

    def paths(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(labels, counts): the shortest paths of the strings codes[starts : starts + sizes], of two characters or more."""
        order = np.argsort(-sizes, kind="stable")
        at, n = starts[order], sizes[order]
        off = np.cumsum(n + 1) - n - 1
        cost, back = np.full(int((n + 1).sum()), FAR), np.full(int((n + 1).sum()), -1, np.int64)
        cost[off] = 0
        for i in range(int(n[0]) if len(n) else 0):
            rows = np.arange(np.searchsorted(-n, -i))
            rows = rows[cost[off[rows] + i] < FAR]
            reach, before = cost[off[rows] + i] + 1, back[off[rows] + i]
            place, left, node = at[rows] + i, n[rows] - i, np.zeros(len(rows), np.uint64)
            to, arcs = off[rows] + i, []
            while len(to):
                found = self.trie.find(node << np.uint64(21) | codes[place])
                to, place, left = to + 1, place + 1, left - 1
                piece = self.node_piece[found]
                if len(c := np.flatnonzero((found >= 0) & (piece >= 0) & (reach < cost[to]))):
                    arcs.append((to[c], piece[c], reach[c], before[c]))
                go = np.flatnonzero((found >= 0) & (left > 0))
                to, place, left, node, reach, before = to[go], place[go], left[go], found[go].astype(np.uint64), reach[go], before[go]
            if arcs:
                to, piece, reach, before = (np.concatenate(x) for x in zip(*arcs, strict=True))
                finite = np.flatnonzero(self.weighed(before, piece))
                cost[to[finite]], back[to[finite]] = reach[finite], piece[finite]  # at most one arc of this round leads to a place
        counts = cost[off + n].astype(np.int64)
        given = counts[np.argsort(order)]
        begins = (np.cumsum(given) - given)[order]
        labels, to, rows = np.zeros(int(counts.sum()), np.int64), off + n, np.arange(len(n))
        while len(rows):
            piece = back[to]
            labels[begins[rows] + cost[to] - 1] = piece
            to = to - self.size[piece]
            go = to > off[rows]
            to, rows = to[go], rows[go]
        return labels, given

    def shortest(self, string: str) -> list[int]:
        """Labels of the shortest path of one string, whatever its length."""
        n, arcs, pieces = len(string), self.arcs, self.node_piece
        cost, back = [int(FAR)] * (n + 1), [-1] * (n + 1)
        cost[0] = 0
        known: dict[tuple[int, int], bool] = {}
        for i in range(n):
            reach, before, node, k = cost[i] + 1, back[i], 0, i
            while k < n and (node := arcs.get((node, ord(string[k])), -1)) >= 0:
                k += 1
                if reach < cost[k] and (piece := int(pieces[node])) >= 0:
                    if (before, piece) not in known:
                        known[before, piece] = bool(self.weighed(np.array([before]), np.array([piece]))[0])
                    if known[before, piece]:
                        cost[k], back[k] = reach, piece
        path, i = [], n
        while i:
            path.append(back[i])
            i -= int(self.size[back[i]])
        return path[::-1]

    def learn(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of strings."""
        own: list[np.ndarray] = []
        counts = np.zeros(len(starts), np.int64)
        single, usual, long = np.flatnonzero(sizes == 1), np.flatnonzero((sizes > 1) & (sizes <= LONG)), np.flatnonzero(sizes > LONG)
        chars = codes[starts[single]]
        alone = [[] if c == END_CODE else [p] if p >= 0 else self.fallback(chr(c)) for c, p in zip(chars.tolist(), self.char_piece[chars].tolist(), strict=True)]
        counts[single] = [len(x) for x in alone]
        own.append(np.array([i for x in alone for i in x], np.int32))
        labels, n_labels = self.paths(codes, starts[usual], sizes[usual])
        walked = [self.shortest(codes[a : a + k].tobytes().decode("utf-32-le", "surrogatepass")) for a, k in zip(starts[long].tolist(), sizes[long].tolist(), strict=True)]
        labels = np.concatenate((labels, *[np.array(x, np.int64) for x in walked]))
        n_labels = np.append(n_labels, np.array([len(x) for x in walked], np.int64))
        which = np.append(usual, long)
        if len(self.ids_of) > len(self.text):  # symbols that are written as bytes
            n_ids = np.array([len(x) for x in self.ids_of])[labels]
            flat = np.array([i for k in labels.tolist() for i in self.ids_of[k]], np.int32)
            ends = np.append(0, np.cumsum(n_ids))[np.append(0, np.cumsum(n_labels))]
            counts[which] = np.diff(ends)
        else:
            flat, counts[which] = labels.astype(np.int32), n_labels
        begins, out = np.cumsum(counts) - counts, np.zeros(int(counts.sum()), np.int32)
        out[spread(begins[single], counts[single])] = own[0]
        out[spread(begins[which], counts[which])] = flat
        return out, counts

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): those of all texts, joined, and where each text's end."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        codes, ends = codes_of([" " + t if t else "" for t in texts])
        codes[codes == ord(SPACE_MARK)] = 32
        kinds = self.char_class[codes].astype(np.intp)
        starts = np.flatnonzero(np.append(True, ~self.joins.ravel()[kinds[:-1] * len(self.joins) + kinds[1:]]))
        ids, counts = self.store.numbers(self.store.entries(codes, starts, lambda at, sizes: self.learn(codes, at, sizes)))
        return ids, np.cumsum(counts)[np.searchsorted(starts, ends)]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text or ""])[0]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8, offsets) of the texts that the ids stand for; undone are the normaliser's leading spaces."""
        flat, sizes = self._flat
        begins = np.cumsum(sizes) - sizes
        out = flat[spread(begins[ids], sizes[ids])]
        stops = np.append(0, np.cumsum(sizes[ids]))[np.append(0, ends)]
        first = stops[:-1][np.diff(stops) > 0]
        cut = first[out[first] == 32]
        return np.delete(out, cut), stops - np.searchsorted(cut, stops)

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        return self.decode_all(ids, np.array([len(ids)]))[0].tobytes().decode("utf-8", "replace")


def machine(path: str) -> Transducer:
    """One transducer for each worker and model."""
    return kept_by_worker(("pieces", path), lambda: Transducer(path))


#: What tokenized() can add, and the types.
OUTPUTS = {"ids": "array<int>", "ids_crc32": "bigint", "decoded": "string"}
#: Rows that are read from a batch at a time.
ROWS = 128


def tokenized(docs: DataFrame, outputs: tuple[str, ...] = ("ids",), path: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with the columns named in outputs: token ids, their unsigned crc32 (as little-endian 32-bit
    integers), the text decoded from them. One worker does all, on about BATCH_CHARS characters at a time."""
    path = path or model_path()

    def made(m: Transducer, rows: pa.Array, texts: list[str]) -> pa.RecordBatch:
        ids, ends = m.encode_all(texts)
        offsets = np.append(0, ends).astype(np.int32)
        out = {}
        if "ids" in outputs:
            out["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
        if "ids_crc32" in outputs:
            raw = memoryview(ids.astype("<i4").tobytes())
            out["ids_crc32"] = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), ends.tolist(), strict=True)], pa.int64())
        if "decoded" in outputs:
            utf8, stops = m.decode_all(ids, ends)
            out["decoded"] = pa.StringArray.from_buffers(len(texts), pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(utf8))
        return pa.RecordBatch.from_arrays([rows, *[out[k] for k in outputs]], names=["row", *outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(path)
        for batch in batches:
            at = 0
            for texts in by_size((t for k in range(0, batch.num_rows, ROWS) for t in batch.column(1).slice(k, ROWS).to_pylist()), BATCH_CHARS):
                yield made(m, batch.column(0).slice(at, len(texts)), texts)
                at += len(texts)

    kept = [F.col(f"`{c}`") for c in others(docs, *outputs)]
    # An empty struct can't be sent.
    rows = docs.select(F.struct(*kept or [F.lit(None).cast("int").alias("none")]).alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], *[T.StructField(k, T._parse_datatype_string(OUTPUTS[k])) for k in outputs]])
    return rows.mapInArrow(run, schema).select(*(["row.*"] if kept else []), *outputs)


def decoded(rows: DataFrame, path: str | None = None, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the text out of the token ids; a null array gives an empty text."""
    path = path or model_path()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = machine(path)
        for arrays in batches:
            yield pd.Series(["" if a is None else m.decode(a) for a in arrays], dtype=object)

    return rows.withColumn(out, F.pandas_udf(run, "string")(F.col(ids_col)))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, their decoding, and whether it returns the text."""
    rows = tokenized(table(spark, sf_dir, "documents").select("doc_id", "text"), ("ids", "ids_crc32", "decoded"))
    text = F.translate(F.coalesce("text", F.lit("")), SPACE_MARK, " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_crc32", F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"), (F.col("decoded") == text).alias("round_trip"))


QUERIES = {"op3_pieces": op3_pieces}
ORACLES: dict[str, str] = {}
