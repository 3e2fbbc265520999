"""Byte-level BPE encoding and decoding by speculation and verification.

Each distinct word (a pre-token) first gets tokens by greedy longest match. A sequence of tokens is what merging would
give exactly when every two neighbours, merged on their own, stay these two tokens; so one vectorised look-up of all
adjacent pairs tells which proposals stand. Only words with a pair that does not stand undergo exact merging.
Whole texts are encoded: a text's tokens are its words' tokens one after the other. Decoding joins the tokens' bytes
and reads them as UTF-8, where broken sequences give U+FFFD.

Special tokens of the vocabulary file are found in a text as they stand, as the file says. Null texts count as empty
and give no tokens. Extra columns do no harm: only the named ones are read. The tokenizer's file is a parameter; it
must lie at the same path on all executors.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.textkit import expand, lists, slices, small_batches, tidy

#: The pattern that splits a text into words; a fixed value of this family of tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters that newer Unicode versions know as letters or numbers, but the tokenizers library (16.0) takes for neither.
LATE = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1"
    "\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff"
    "\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5"
    "\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: Words and pairs that a worker remembers; beyond that it forgets all and goes on.
CACHED_WORDS, CACHED_PAIRS = 200_000, 1_000_000
#: Words of more bytes, and of lengths that few words have, are merged one by one.
_LONG, _FEW = 48, 8
_NEVER = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable Latin-1 for itself, others from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteBPE:
    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        letters = byte_letters()
        read = lambda word: bytes(letters[c] for c in word)
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        vocab = {word: k for word, k in data["model"]["vocab"].items() if word not in self.special}
        self.ids = {read(word): k for word, k in vocab.items()}
        self.bytes = {k: word for word, k in self.ids.items()} | {k: text.encode() for text, k in self.special.items()}
        self.longest = max(map(len, self.ids))
        self.merges = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]):
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.single = [self.ids[bytes((b,))] for b in range(256)]
        find, late = regex.compile(pattern).findall, re.compile(f"[{LATE}]").search
        letters, numbers = f"[\\p{{L}}--[{LATE}]]", f"[\\p{{N}}--[{LATE}]]"
        others = rf"(?:[^\s\p{{L}}\p{{N}}]|[{LATE}])"
        careful = regex.compile("(?V1)" + pattern.replace(r"[^\s\p{L}\p{N}]", others).replace(r"?\p{L}", f"?{letters}").replace(r"?\p{N}", f"?{numbers}")).findall
        self.find = lambda text: find(text) if text.isascii() or not late(text) else careful(text)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.base = max(self.bytes) + 1
        sizes = np.zeros(self.base, np.int64)
        sizes[list(self.bytes)] = [len(x) for x in self.bytes.values()]
        self.token_sizes, self.token_starts = sizes, np.concatenate(([0], np.cumsum(sizes)))[:-1]
        self.token_bytes = np.frombuffer(b"".join(self.bytes.get(k, b"") for k in range(self.base)), np.uint8)
        merges = np.array(sorted((a * self.base + b, rank, made) for (a, b), (rank, made) in self.merges.items()), np.int64).reshape(-1, 3)
        self.merge_codes, self.merge_ranks = merges[:, 0].copy(), merges[:, 1].astype(np.int32)
        self.merge_makes = np.zeros(int(merges[:, 1].max(initial=-1)) + 1, np.int64)
        self.merge_makes[merges[:, 1]] = merges[:, 2]
        self.pair_codes, self.pair_stands = np.zeros(0, np.int64), np.zeros(0, bool)
        self._forget()

    def _forget(self) -> None:
        self.code: dict[str, int] = {}
        self.pool, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    # --- one word ---

    def greedy(self, word: bytes) -> list[int]:
        """The longest token at each place."""
        ids, out, at, n = self.ids, [], 0, len(word)
        if (whole := ids.get(word)) is not None:
            return [whole]
        while at < n:
            end = min(n, at + self.longest)
            while word[at:end] not in ids:
                end -= 1
            out.append(ids[word[at:end]])
            at = end
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, of equal ones the leftmost."""
        parts, merges = [self.single[b] for b in word], self.merges
        if len(parts) <= _LONG:
            while len(parts) > 1:
                best = min((merges[p] + (k,) for k, p in enumerate(zip(parts, parts[1:])) if p in merges), default=None)
                if best is None:
                    break
                parts[best[2] : best[2] + 2] = [best[1]]
            return parts
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(*merges[p], k, p) for k, p in enumerate(zip(parts, parts[1:])) if p in merges]
        heap = [(rank, k, new, p) for rank, new, k, p in heap]
        heapq.heapify(heap)
        n = len(parts)
        while heap:
            _, k, new, (a, b) = heapq.heappop(heap)
            right = after[k]
            if parts[k] != a or right >= n or parts[right] != b:
                continue
            parts[k], parts[right] = new, -1
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n and (p := (parts[left], parts[after[left]])) in merges:
                    rank, made = merges[p]
                    heapq.heappush(heap, (rank, left, made, p))
        return [p for p in parts if p >= 0]

    # --- many words ---

    def ranks(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens; ``_NEVER`` where they are not merged."""
        if not len(self.merge_codes):
            return np.full(first.shape, _NEVER, np.int32)
        codes = first * self.base + second
        at = np.minimum(np.searchsorted(self.merge_codes, codes), len(self.merge_codes) - 1)
        return np.where(self.merge_codes[at] == codes, self.merge_ranks[at], _NEVER)

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many words, those of one length together."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out: list[list[int]] = [[]] * len(words)
        for size in np.unique(sizes).tolist():
            same = np.flatnonzero(sizes == size).tolist()
            if size < 2 or size > _LONG or len(same) < _FEW:
                for k in same:
                    out[k] = self.merge(words[k])
                continue
            for low in range(0, len(same), 20_000):
                part = same[low : low + 20_000]
                self._merge_rows(np.frombuffer(b"".join([words[k] for k in part]), np.uint8).reshape(-1, size), np.array(part), out)
        return out

    def _merge_rows(self, spelled: np.ndarray, names: np.ndarray, out: list[list[int]]) -> None:
        """One merge a round in each word that has one left, so that these words keep one width; a word without goes to its place in ``out``."""
        tokens = np.array(self.single)[spelled]
        rank = self.ranks(tokens[:, :-1], tokens[:, 1:])
        while True:
            best = rank.min(axis=1, initial=_NEVER)
            for k, found in zip(names[best == _NEVER].tolist(), tokens[best == _NEVER].tolist()):
                out[k] = found
            live = best < _NEVER
            if not live.any():
                return
            names, tokens, rank, best = names[live], tokens[live], rank[live], best[live]
            row, place = np.arange(len(names)), rank.argmin(axis=1)
            tokens[row, place] = self.merge_makes[best]
            column = np.arange(tokens.shape[1] - 1)
            tokens = np.take_along_axis(tokens, column + (column > place[:, None]), axis=1)
            rank = np.take_along_axis(rank, column[:-1] + (column[:-1] >= place[:, None]), axis=1)
            for left, has in ((place - 1, place > 0), (place, place < tokens.shape[1] - 1)):
                at, left = row[has], left[has]
                rank[at, left] = self.ranks(tokens[at, left], tokens[at, left + 1])

    def stands(self, codes: np.ndarray) -> np.ndarray:
        """Per pair of tokens (first * base + second; first is base for a word of one token): whether merging keeps it."""
        asked, back = np.unique(codes, return_inverse=True)
        at = np.searchsorted(self.pair_codes, asked)
        known = (at < len(self.pair_codes)) & (self.pair_codes[np.minimum(at, max(len(self.pair_codes) - 1, 0))] == asked) if len(self.pair_codes) else np.zeros(len(asked), bool)
        if not known.all():
            new = asked[~known]
            pairs = [[t for t in divmod(code, self.base + 1) if t < self.base] for code in new.tolist()]
            merged = self.merge_all([b"".join(map(self.bytes.__getitem__, pair)) for pair in pairs])
            fine = [found == pair for found, pair in zip(merged, pairs)]
            keep = len(self.pair_codes) + len(new) <= CACHED_PAIRS
            pool = np.concatenate((self.pair_codes, new)) if keep else np.union1d(asked[known], new)
            stand = np.concatenate((self.pair_stands, fine)) if keep else None
            if stand is None:
                have = dict(zip(self.pair_codes.tolist(), self.pair_stands.tolist())) | dict(zip(new.tolist(), fine))
                stand = np.array([have[c] for c in pool.tolist()], bool)
            order = np.argsort(pool, kind="stable")
            self.pair_codes, self.pair_stands = pool[order], stand[order].astype(bool)
            at = np.searchsorted(self.pair_codes, asked)
        return self.pair_stands[at][back]

    def learn(self, words: list[str]) -> None:
        """Encodes words that are not known yet: proposals, verification of all adjacent pairs, merging of what fails."""
        spelled = [w.encode() for w in words]
        tokens = [self.greedy(w) for w in spelled]
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter((t for ts in tokens for t in ts), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(tokens)), counts)
        ends = np.cumsum(counts)
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = False
        at = np.flatnonzero(inner)
        codes = flat[at] * (self.base + 1) + flat[at + 1]
        alone = np.flatnonzero(counts == 1)
        codes = np.concatenate((codes, self.base * (self.base + 1) + flat[ends[alone] - 1]))
        failing = np.unique(np.concatenate((owner[at], alone))[~self.stands(codes)])
        for k, found in zip(failing.tolist(), self.merge_all([spelled[k] for k in failing.tolist()])):
            tokens[k] = found
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.code.update(zip(words, range(len(self.code), len(self.code) + len(words))))
        self.starts = np.concatenate((self.starts, len(self.pool) + np.cumsum(counts) - counts))
        self.counts = np.concatenate((self.counts, counts))
        self.pool = np.concatenate((self.pool, np.fromiter((t for ts in tokens for t in ts), np.int32, int(counts.sum()))))

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number per text."""
        if len(self.code) > CACHED_WORDS:
            self._forget()
        words, per_text, specials = [], [], []
        for text in texts:
            before = len(words)
            if self.split and any(s in text for s in self.special):
                for k, part in enumerate(self.split(text)):
                    if k % 2:
                        specials.append((len(words), self.special[part]))
                        words.append(" ")  # its place; the token is put in below
                    else:
                        words += self.find(part)
            else:
                words += self.find(text)
            per_text.append(len(words) - before)
        if new := [w for w in dict.fromkeys(words) if w not in self.code]:
            self.learn(new)
        codes = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        counts = self.counts[codes]
        ids = self.pool[expand(self.starts[codes], counts)]
        begins = np.concatenate(([0], np.cumsum(counts)))
        for place, token in specials:
            ids[begins[place]] = token
        ends = np.concatenate(([0], np.cumsum(np.array(per_text, np.int64))))
        return ids, begins[ends[1:]] - begins[ends[:-1]]

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The text of each run of ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.base):
            raise ValueError("an id is outside the vocabulary")
        sizes = self.token_sizes[ids]
        flat = self.token_bytes[expand(self.token_starts[ids], sizes)]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        offsets = ends[np.concatenate(([0], np.cumsum(counts)))]
        out = pa.StringArray.from_buffers(len(counts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat)))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            data = flat.tobytes()
            out = pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])], pa.string())
        return out


@cache
def tokenizer(path: str) -> ByteBPE:
    """One per worker process."""
    return ByteBPE(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the id, the kept columns, and the token ids of the whole text (``ids``, array<int>)."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`"), *(F.col(f"`{k}`") for k in keep), F.col(f"`{text_col}`").alias("__text"))
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for part, flat, offsets in slices(batch, "__text"):
                data = flat.tobytes()
                ids, counts = bpe.encode_batch([data[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])])
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), lists(ids, counts)], [*names, "ids"])
        bpe._forget()

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    return rows.mapInArrow(tidy(run), f"{own}, ids array<int>")


def decode(df: DataFrame, path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the kept columns, the ids, and the text that they stand for (``decoded``). Null ids count as none."""
    rows = df.select(*keep, F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    names = [*keep, "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            at = 0
            sizes = np.diff(batch.column("ids").offsets.to_numpy()).astype(np.int64)
            steps = np.cumsum(sizes)
            while at < len(batch):
                end = max(at + 1, int(np.searchsorted(steps, (steps[at - 1] if at else 0) + 500_000, "right")))
                part = batch.slice(at, end - at)
                column = part.column("ids")
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), bpe.decode_batch(column.flatten().to_numpy().astype(np.int64), sizes[at:end])], [*names, "decoded"])
                at = end

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(tidy(run), f"{own}, decoded string")


