"""Sampled SentencePiece segmentations: forward filtering and backward sampling over the lattice of pieces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import mix64, narrow, ranges, release, slices, worker_cache

SPACE = 0x2581
#: A literal U+2581 of a text must not look like a space, so it stands for a code point that no piece has.
LITERAL_SPACE_MARK = 0x110000
BASE = np.uint64(0x9E3779B97F4A7C15)
SHARPNESS = 1.0
SEED = 10
SLICE = 3 << 20
#: Per character, in logarithms: about what a character of a common word costs.
SCALE = 2.0
#: Units from this many characters on are summed in logarithms.
LONG = 48
DECODED_IDS = 1 << 18


class HashTable:
    """64-bit keys, scrambled already, to whole numbers: a look-up of many keys is a few gathers, however many keys there are."""

    def __init__(self, keys: list[int], values: list[int]):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros((1 << bits) + 64, np.uint64)
        self.values = np.full((1 << bits) + 64, -2, np.int64)
        for key, value in zip(keys, values):
            at = key >> (64 - bits)
            while self.values[at] != -2:
                at += 1
            self.keys[at], self.values[at] = key, value

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, -2 for those that are not there."""
        at = (keys >> self.shift).astype(np.int64)
        out = self.values[at]
        other = np.flatnonzero((self.keys[at] != keys) & (out != -2))
        while len(other):
            at[other] += 1
            out[other] = self.values[at[other]]
            other = other[(self.keys[at[other]] != keys[other]) & (out[other] != -2)]
        return out


def _times(k: int) -> np.uint64:
    return np.uint64(k * int(BASE) & 0xFFFFFFFFFFFFFFFF)


class Pieces:
    """Pieces of a model by the rolling hashes of their prefixes (-1: no piece, but the beginning of one), their log weights, and the bytes each id stands for.

    A model that scores pieces by merge order has no probabilities; its pieces
    weigh as a Zipf law of their rank, to the power of ``sharpness``. A unigram
    model's log probabilities are used as they are, times ``sharpness``.
    """

    def __init__(self, path: str, sharpness: float = SHARPNESS):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        normal = [i for i in range(self.size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        scores = np.array([sp.get_score(i) for i in normal])
        ranks = bool(len(scores)) and bool(np.all(scores == np.round(scores)))
        weights = -np.log(2 - scores) if ranks else scores
        self.weight = np.full(self.size, -np.inf)
        self.weight[normal] = weights * sharpness
        self.byte_id = np.full(256, -1, np.int64)
        self.raw = [b""] * self.size
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
        prefixes: dict[int, int] = {}
        self.longest = 0
        for i in normal:
            piece = sp.id_to_piece(i)
            self.raw[i] = piece.replace("▁", " ").encode()
            if "▁" in piece[1:]:
                continue  # a unit has one leading space, see units()
            h = 0
            for n, c in enumerate(piece, 1):
                h = (h + ord(c) + 1) * int(BASE) & 0xFFFFFFFFFFFFFFFF
                h ^= h >> 32
                prefixes.setdefault(h, -1)
            if prefixes[h] not in (-1, i):
                raise ValueError("two pieces have the same hash")
            prefixes[h] = i
            self.longest = max(self.longest, len(piece))
        self.prefixes = HashTable([h * int(BASE) & 0xFFFFFFFFFFFFFFFF for h in prefixes], list(prefixes.values()))
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces, so texts with other characters could not be restored")
        self.byte_weight = float(self.weight[normal].min()) * 2 if normal else -20.0
        self.raw_length = np.array([len(x) for x in self.raw], np.int64)
        self.raw_first = np.cumsum(self.raw_length) - self.raw_length
        self.raw_flat = np.frombuffer(b"".join(self.raw), np.uint8)


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What follows each blank of " " + text, flat, and the offsets of each text's units; an empty text has none."""
    split = pc.split_pattern(texts, " ")
    n = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    flat = split.flatten()
    if empty.any():
        keep = np.repeat(~empty, n)
        flat, n = flat.filter(pa.array(keep)), np.where(empty, 0, n)
    return flat, np.concatenate([[0], np.cumsum(n)])


def joined(strings: pa.Array) -> str:
    """All strings of an array without nulls, one after the other."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset:strings.offset + len(strings) + 1]
    body = strings.buffers()[2]
    return body.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes().decode() if body is not None and len(strings) else ""


class Lattice:
    """Edges of the lattices of distinct units, with the chance of each edge among those that end where it ends.

    Nodes are numbered by their place in the unit, then by falling length of the
    unit, so that what a step of the filter reads and writes lies side by side.
    """

    def __init__(self, distinct: pa.Array, pieces: Pieces):
        n_chars = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
        length = n_chars + 1
        begin = np.cumsum(length + 1) - (length + 1)  # unit by unit: before, between and after its characters
        by_length = np.argsort(-length, kind="stable")
        rank = np.empty(len(length), np.int64)
        rank[by_length] = np.arange(len(length))
        # Units that have a place, and the first node of it; all units begin in the first ones.
        reach = np.searchsorted(-length[by_length], -np.arange(int(length.max(initial=0)) + 1), "right")
        base = np.cumsum(reach) - reach
        self.n_units = len(length)
        self.end = base[length] + rank
        node = base[ranges(np.zeros(len(length), np.int64), length + 1)] + np.repeat(rank, length + 1)
        cp = np.full(int((length + 1).sum()), 0, np.uint64)
        text = np.frombuffer(joined(distinct).encode("utf-32-le"), np.uint32).astype(np.uint64)
        text = np.where(text == SPACE, np.uint64(LITERAL_SPACE_MARK), text)
        cp[ranges(begin + 1, n_chars)] = text
        cp[begin] = SPACE
        stop = np.repeat(begin + length, length + 1)
        at = ranges(begin, length)
        h = np.zeros(len(at), np.uint64)
        alive = at
        sources, targets, found = [], [], []
        single = np.zeros(len(cp), bool)
        for n in range(1, pieces.longest + 1):
            h = (h + cp[alive + n - 1] + np.uint64(1)) * BASE
            h ^= h >> np.uint64(32)
            piece = pieces.prefixes.find(h * BASE)
            real = piece >= 0
            which = alive[real]
            sources.append(node[which]), targets.append(node[which + n]), found.append(piece[real])
            if n == 1:
                single[which] = True
            known = (piece > -2) & (alive + n < stop[alive])
            alive, h = alive[known], h[known]
        # Characters without a piece of their own: one edge that stands for their UTF-8 bytes.
        bare = at[~single[at]]
        self.rare, code = np.unique(cp[bare], return_inverse=True)
        sources.append(node[bare]), targets.append(node[bare + 1]), found.append(pieces.size + code)
        self.rare_bytes = [chr(SPACE if c == LITERAL_SPACE_MARK else int(c)).encode("utf-8", "surrogatepass") for c in self.rare.tolist()]
        rare_weight = np.array([len(b) * pieces.byte_weight for b in self.rare_bytes])
        # Edges in order of the node they end at. No node has two edges of one length, so each length is dealt out at once;
        # long pieces go first, as they are the likelier ones.
        degree = np.zeros(len(cp), np.int64)
        for to in targets:
            degree[to] += 1
        self.first_edge = np.cumsum(degree) - degree
        self.last_edge = self.first_edge + degree - 1
        n_edges = int(degree.sum())
        src, kind, place = np.empty(n_edges, np.int64), np.empty(n_edges, np.int64), self.first_edge.copy()
        for a, to, piece in zip(sources[::-1], targets[::-1], found[::-1]):
            edge = place[to]
            src[edge], kind[edge] = a, piece
            place[to] += 1
        # Forward filtering, character by character over all units that are long enough. Weights are scaled by a constant per
        # character, which leaves shares as they are and keeps sums of short units near 1; long units are summed in logarithms.
        place = np.repeat(np.arange(len(reach)), reach)
        scale = np.concatenate([pieces.weight, rare_weight])[kind] + SCALE * (np.repeat(place, degree) - place[src])
        share, total = np.empty(n_edges), np.empty(len(cp))
        n_long = int(np.searchsorted(-length[by_length], -LONG, "left"))
        total[:n_long], total[n_long:self.n_units] = 0.0, 1.0
        for first, n in zip(base[1:].tolist(), reach[1:].tolist()):
            for logs, a, b in ((True, first, first + min(n, n_long)), (False, first + min(n, n_long), first + n)):
                if a == b:
                    continue
                edges = slice(int(self.first_edge[a]), int(self.last_edge[b - 1]) + 1)
                into, many = self.first_edge[a:b] - edges.start, degree[a:b]
                if logs:
                    way = total[src[edges]] + scale[edges]
                    total[a:b] = np.logaddexp.reduceat(way, into)
                    share[edges] = np.exp(way - np.repeat(total[a:b], many))
                else:
                    way = total[src[edges]] * np.exp(scale[edges])
                    total[a:b] = np.add.reduceat(way, into)
                    share[edges] = way / np.repeat(total[a:b], many)
        self.src, self.kind = src, kind
        self.cumulated = np.cumsum(share)
        self.before = np.concatenate([[0.0], self.cumulated])

    def sample(self, codes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Kinds of the sampled pieces of each unit (flat, in text order) and how many each unit has."""
        node = self.end[codes].copy()
        at = np.arange(len(codes))
        steps, kinds = [], []
        k = 0
        while len(at):
            draw = mix64(seeds[at] + _times(k))
            low, high = self.first_edge[node], self.last_edge[node]
            u = (draw >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
            low_sum = self.before[low]
            goal = low_sum + u * (self.cumulated[high] - low_sum)
            edge = low
            on = np.flatnonzero((self.cumulated[edge] <= goal) & (edge < high))
            while len(on):
                edge[on] += 1
                on = on[(self.cumulated[edge[on]] <= goal[on]) & (edge[on] < high[on])]
            steps.append(at), kinds.append(self.kind[edge])
            node = self.src[edge]
            more = node >= self.n_units
            at, node = at[more], node[more]
            k += 1
        count = np.zeros(len(codes), np.int64)
        for s in steps:
            count[s] += 1
        end = np.cumsum(count)
        out = np.empty(int(end[-1]) if len(end) else 0, np.int64)
        for k, (s, found) in enumerate(zip(steps, kinds)):
            out[end[s] - 1 - k] = found
        return out, count


def encode_batch(texts: pa.Array, keys: np.ndarray, pieces: Pieces, seed: int = SEED) -> pa.Array:
    """Sampled ids of each text; ``keys`` are 64-bit row keys."""
    values, ends, done = [], [np.zeros(1, np.int64)], 0
    for at, part in slices(texts, SLICE):
        flat, offsets = units(part)
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        lattice = Lattice(coded.dictionary, pieces)
        n = np.diff(offsets)
        nth = np.arange(len(codes)) - np.repeat(offsets[:-1], n)
        row = mix64(keys[at:at + len(part)] + _times(seed))
        kinds, count = lattice.sample(codes, mix64(np.repeat(row, n) + nth.astype(np.uint64)))
        wide = np.concatenate([np.ones(pieces.size, np.int64), np.array([len(b) for b in lattice.rare_bytes], np.int64)])
        table = np.concatenate([np.arange(pieces.size), pieces.byte_id[np.frombuffer(b"".join(lattice.rare_bytes), np.uint8)]])
        first = np.cumsum(wide) - wide
        took = wide[kinds]
        values.append(table[ranges(first[kinds], took)].astype(np.int32))
        by_unit = np.concatenate([[0], np.cumsum(count)])
        by_kind = np.concatenate([[0], np.cumsum(took)])
        ends.append(by_kind[by_unit[offsets[1:]]] + done)
        done += int(by_kind[-1])
        del lattice, kinds, codes, coded, flat
    release()
    flat = np.concatenate(values) if values else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(flat, pa.int32()))


def decode_batch(ids: pa.Array, pieces: Pieces) -> pa.Array:
    """The texts that ids stand for: pieces joined, without the blank in front of the first one."""
    n = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    every = ids.flatten().to_numpy(zero_copy_only=False)
    rows = np.concatenate([[0], np.cumsum(n)])
    out, at = [], 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(rows, rows[at] + DECODED_IDS, "right")) - 1)
        flat = every[rows[at]:rows[to]]
        length = pieces.raw_length[flat]
        raw = pieces.raw_flat[ranges(pieces.raw_first[flat], length)].tobytes()
        ends = np.concatenate([[0], np.cumsum(length)])[rows[at:to + 1] - rows[at]].tolist()
        for a, b in zip(ends, ends[1:]):
            text = raw[a:b].decode("utf-8", "replace")
            out.append(text[1:] if text.startswith(" ") else text)
        at = to
    return pa.array(out, pa.string())


def encode(model: str, key: str | Column, text: str | Column, sharpness: float = SHARPNESS, seed: int = SEED) -> Column:
    """Ids of one sampled segmentation of a whole text, the same in every run for the same key, text, seed and model.

    Spaces become U+2581 in front of what follows them; a lattice spans what lies
    between two blanks, and a piece never crosses one. Its paths are drawn with a
    chance in proportion to the product of their pieces' weights: sums over all
    paths are filtered forward, then pieces are drawn from the end backward.
    Characters without a piece become their UTF-8 bytes. A null text counts as empty
    and has no ids; a null key is a key like any other. Equal rows get equal ids.
    """
    @F.arrow_udf("array<int>")
    def ids(keys: pa.Array, texts: pa.Array) -> pa.Array:
        pieces = worker_cache(f"pieces:{model}:{sharpness}", lambda: Pieces(model, sharpness))
        return encode_batch(texts, keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), pieces, seed)

    key = F.col(f"`{key}`") if isinstance(key, str) else key
    text = F.col(f"`{text}`") if isinstance(text, str) else text
    return ids(F.xxhash64(key), text.cast("string"))


def decode(model: str, ids: str | Column) -> Column:
    """The text of ids; null and empty arrays give an empty text. Sampled or not, ids of a text restore it exactly."""
    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        return decode_batch(lists, worker_cache(f"pieces:{model}:1", lambda: Pieces(model)))

    return text(F.col(f"`{ids}`") if isinstance(ids, str) else ids)


def sampled_segmentations(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, ids and the text decoded from them, for every row; an empty table gives an empty result and other columns are not read."""
    rows = narrow(df, doc_id=id_col, text=F.col(f"`{text_col}`").cast("string"))
    return rows.withColumn("ids", encode(model, "doc_id", "text", seed=seed)).withColumn("decoded", decode(model, "ids"))
