"""URL filters by a bit-parallel wildcard automaton.

Every glob becomes a chain of states; the chains of all globs lie side by side in one row of 64-bit words, and one
shift, two masks and an or move all of them over one byte of a URL (Shift-And with self-loops for the wildcards).
URLs of an Arrow batch move in step, so that the work per byte is a few vector operations.

Globs are matched against the canonical URL, which is the lower-cased host followed by the path: ``*`` stands for any
bytes but ``/`` (so it cannot leave the host), ``**`` for any bytes, ``?`` for one byte but ``/``.

Null URLs and those without ``://`` have an empty host and path, match no host rule, and get the default verdict.
Columns with clashing names do no harm, as only the named id and URL columns are read; an empty table gives an empty
result; repeated rows give repeated results; of globs that match alike the longest rule wins, then the first given.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.textkit import clean, tidy, utf8

ONE, TOP = np.uint64(1), np.uint64(63)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """A host (with all subdomains) and the start of a path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def globs(self) -> tuple[str, str]:
        return f"{self.name}**", f"*.{self.name}**"


RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)
#: Where no rule fits: URLs that any of these globs matches are blocked, all others allowed.
SPAM_GLOBS = ("**cheap-pills**", "**spam-farm**", "**casino**", "**free-download**", "**viagra**", "**/wp-login.php**", "**xxx**")


class GlobAutomaton:
    """All globs as one nondeterministic automaton whose states are the bits of a few words."""

    def __init__(self, globs: Sequence[str]):
        chains = [self._parse(g.encode()) for g in globs]
        size = sum(len(steps) + 1 for steps, _ in chains)
        self.words = max(1, -(-size // 64))
        step, loop = np.zeros((256, self.words * 64), bool), np.zeros((256, self.words * 64), bool)
        start, self.final, at = np.zeros(self.words * 64, bool), [], 0
        for steps, loops in chains:
            start[at] = True
            for j, accepted in enumerate(steps, 1):
                step[:, at + j] = accepted
            for j, accepted in loops.items():
                loop[:, at + j] |= accepted
            self.final.append(at + len(steps))
            at += len(steps) + 1
        self.step, self.loop, self.start = self._pack(step), self._pack(loop), self._pack(start[None])[0]

    @staticmethod
    def _parse(glob: bytes) -> tuple[list[np.ndarray], dict[int, np.ndarray]]:
        anything, steps, loops, i = np.ones(256, bool), [], {}, 0
        no_slash = anything.copy()
        no_slash[ord("/")] = False
        while i < len(glob):
            if glob[i : i + 2] == b"**":
                loops[len(steps)], i = anything, i + 2
            elif glob[i] == ord("*"):
                loops[len(steps)] = loops.get(len(steps), no_slash) | no_slash
                i += 1
            else:
                one = np.zeros(256, bool)
                one[glob[i]] = True
                steps.append(no_slash if glob[i] == ord("?") else one)
                i += 1
        return steps, loops

    @staticmethod
    def _pack(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1, bitorder="little").view("<u8").astype(np.uint64)

    def matches(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per row and glob: whether the glob matches the whole row."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        begins, sizes = offsets[:-1][order], lengths[order]
        state = np.repeat(self.start[None], len(order), axis=0)
        active = len(order)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            while sizes[active - 1] <= t:
                active -= 1
            byte, now = flat[begins[:active] + t], state[:active]
            moved = now << ONE
            moved[:, 1:] |= now[:, :-1] >> TOP
            state[:active] = (moved & self.step[byte]) | (now & self.loop[byte])
        out = np.zeros((len(order), len(self.final)), bool)
        for g, bit in enumerate(self.final):
            out[order, g] = (state[:, bit // 64] >> np.uint64(bit % 64)) & ONE != 0
        return out


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = RULES, spam_globs: Sequence[str] = SPAM_GLOBS) -> DataFrame:
    """Per URL: its host and path, the longest rule that fits, the glob that decided where none does, and the verdict."""
    url = F.col("url")
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    canonical = clean(pages, id=id_col, url=url_col).select("id", F.translate(part(1), UPPER, LOWER).alias("host"), part(2).alias("path")).withColumn("canonical", F.concat("host", "path"))
    ranked = sorted(rules, key=lambda r: -len(r.name))
    globs = [g for r in ranked for g in r.globs] + list(spam_globs)

    def scan(batches):
        automaton = GlobAutomaton(globs)
        names, verdicts = [r.name for r in ranked], [r.verdict for r in ranked]
        for batch in batches:
            hit = automaton.matches(*utf8(batch.column("canonical")))
            by_rule = hit[:, : 2 * len(ranked)].reshape(len(hit), len(ranked), 2).any(axis=2)
            by_spam = hit[:, 2 * len(ranked) :]
            rule = np.where(by_rule.any(axis=1), by_rule.argmax(axis=1), -1) if ranked else np.full(len(hit), -1)
            spam = np.where(by_spam.any(axis=1), by_spam.argmax(axis=1), -1) if len(spam_globs) else np.full(len(hit), -1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("host"), batch.column("path"),
                    pa.array([names[r] if r >= 0 else None for r in rule], pa.string()),
                    pa.array([spam_globs[s] if s >= 0 > r else None for r, s in zip(rule, spam)], pa.string()),
                    pa.array([verdicts[r] if r >= 0 else "block" if s >= 0 else "allow" for r, s in zip(rule, spam)], pa.string()),
                ],
                ["id", "host", "path", "rule", "matched", "verdict"],
            )

    kind = canonical.schema["id"].dataType.simpleString()
    return canonical.mapInArrow(tidy(scan), f"id {kind}, host string, path string, rule string, matched string, verdict string").withColumnRenamed("id", id_col)
