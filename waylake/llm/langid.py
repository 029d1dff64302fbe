"""Operator 1: language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A text is parsed greedily into the
longest phrases that the automaton contains; the fewer phrases per letter, weighted by the logarithm
of the automaton's text length, the closer the text is to the language (Ziv-Merhav cross parsing).
The language with the lowest normalised count wins, the first by name on a tie.

A restart after each phrase turns the automaton into a finite machine over characters, with a flag on
moves that start a new phrase. Long texts are cut into blocks, which walk the machine side by side, one array step
per character, each as if a phrase began with it. Then every block that continues a text is walked again from the state
in which the block before it ended, until its states are those of the first walk, most often after a few phrases. So
the phrases are those of one parse of the whole text. The machine has a table for the letters a language uses most and
sorted lists for the others.

The model learns from a bounded sample: per language, the ``sample_rows`` rows first by hash among those
with a letter, of each text the first ``train_chars // 8`` characters from its first letter on, up to
``train_chars`` characters in all. So every language with a letter in a row not held out is learned. It is a few hundred
kB of text, sent to the workers, which build the automata themselves. Prediction covers every whole text.

Cases: null text, or one without a letter, is ``und`` with score 0; a null language is not learned
from; with nothing to learn from everything is ``und``; a null doc_id counts as the empty text for
the held-out split; repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

import collections
import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from waylake.llm.tokens import groups_by_size, loaded

BLOCK = 1024
FLAG = np.int32(1 << 30)
DENSE = 64  # codes of a language that have a column in its table


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_texts(docs: DataFrame, sample_rows: int = 200, train_chars: int = 30_000) -> dict[str, list[str]]:
    """Texts per language, each cut to an eighth of ``train_chars`` characters, that many in all, from rows not held out."""
    part = F.substring(F.regexp_replace("text", r"^\P{L}++", ""), 1, train_chars // 8)
    labelled = docs.select(F.col("doc_id"), "lang", F.length(part).alias("n"), F.xxhash64(part).alias("_t")).where(~held_out() & F.col("lang").isNotNull() & (F.col("n") > 0))
    # repeated rows and texts count once
    labelled = labelled.groupBy("lang", "_t", "n").agg(F.min("doc_id").alias("doc_id"))
    first = W.partitionBy("lang").orderBy("_h", "doc_id", "_t")
    chosen = (
        labelled.withColumn("_h", F.xxhash64("doc_id"))
        .withColumn("_r", F.row_number().over(first))
        .where(F.col("_r") <= sample_rows)
        .select("lang", "doc_id", "n", "_r")
    )
    room = W.partitionBy("lang").orderBy("_r").rowsBetween(W.unboundedPreceding, 0)
    # at most sample_rows rows per language, with no text
    within = chosen.withColumn("_sum", F.sum("n").over(room)).where(F.col("_sum") <= train_chars).select("doc_id", "lang", "_r", "n")
    texts = (
        docs.select("doc_id", "lang", "text")
        .join(F.broadcast(within), ["doc_id", "lang"])  # at most sample_rows rows per language
        .select("lang", "_r", "n", part.alias("text"))
        .where(F.length("text") == F.col("n"))
        .select("lang", "_r", "text")
        .distinct()  # repeated rows of a document
        .orderBy("lang", "_r", "text")
    )
    found: dict[str, list[str]] = {}
    for r in texts.collect():
        kept = found.setdefault(r["lang"], [])
        if r["text"] not in kept and sum(map(len, kept)) + len(r["text"]) <= train_chars:
            kept.append(r["text"])
    return found


def suffix_automaton(text: Sequence[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts all substrings."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        cur = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return moves


def normalised(text: str) -> str:
    """Lower case, with a space for every run of other characters than letters."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class Machine:
    """The finite machine of one language. States are multiples of DENSE; the flag marks a move that starts a phrase."""

    def __init__(self, text: list[int], size: int):
        moves = suffix_automaton(text)
        common = [c for c, _ in collections.Counter(text).most_common()]
        self.local = np.zeros(size, np.int32)  # 0: a letter that the language lacks, a phrase of its own
        self.local[common] = np.arange(1, len(common) + 1)
        local = {c: i for i, c in enumerate(common, 1)}
        first = np.full(len(common) + 1, FLAG, np.int32)
        for c, to in moves[0].items():
            first[local[c]] = to * DENSE | FLAG
        self.first = first
        table = np.tile(first[:DENSE] if len(first) >= DENSE else np.pad(first, (0, DENSE - len(first))), (len(moves), 1))
        rare: list[tuple[int, int]] = []
        for s, m in enumerate(moves[1:], 1):
            for c, to in m.items():
                if local[c] < DENSE:
                    table[s, local[c]] = to * DENSE
                else:
                    rare.append((s * len(first) + local[c], to * DENSE))
        self.table = table.ravel()
        self.has_rare = len(first) > DENSE
        rare.sort()
        self.keys = np.array([k for k, _ in rare] + [1 << 62], np.int64)
        self.next = np.array([to for _, to in rare] + [0], np.int32)

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        if not self.has_rare:
            return self.table[states + codes]
        often = codes < DENSE
        out = self.table[states + np.where(often, codes, 0)]
        if not often.all():
            at = np.flatnonzero(~often)
            keys = (states[at] // DENSE).astype(np.int64) * len(self.first) + codes[at]
            place = np.searchsorted(self.keys, keys)
            out[at] = np.where(self.keys[place] == keys, self.next[place], self.first[codes[at]])
        return out


class CrossParser:
    """Automata of all languages over one alphabet; made from a JSON object of texts by language."""

    def __init__(self, content: str):
        texts = {k: " ".join(map(normalised, v)) for k, v in json.loads(content).items()}
        self.langs = sorted(k for k, v in texts.items() if v)
        letters = sorted({c for t in texts.values() for c in t})
        self.code = {c: i + 1 for i, c in enumerate(letters)}  # 0: a letter that no language has
        self.size = len(letters) + 1
        self.plain = np.zeros(0x3000, np.uint8 if self.size < 256 else np.int32)
        for c, i in self.code.items():
            if ord(c) < 0x3000:
                self.plain[ord(c)] = i
        # all other characters that aren't letters are one space; upper case folds to lower case
        for o in range(0x3000):
            c = chr(o)
            low = c.lower()
            if not c.isalpha():
                self.plain[o] = self.code.get(" ", 0)
            elif len(low) == 1:
                self.plain[o] = self.code.get(low, 0)
        self.is_space = np.array([not chr(o).isalpha() for o in range(0x3000)])
        self.machines = [Machine([self.code[c] for c in texts[k]], self.size) for k in self.langs]
        self.weight = np.array([math.log2(max(2, len(texts[k]))) for k in self.langs])

    def phrases(self, blocks: list[np.ndarray], continues: Sequence[bool] | None = None) -> np.ndarray:
        """Phrases of each block under each language; a block may continue the one before it."""
        order = np.argsort([-len(b) for b in blocks], kind="stable")
        lane_of = np.empty(len(blocks), np.int64)
        lane_of[order] = np.arange(len(blocks))
        width = max((len(b) for b in blocks), default=0)
        raw = np.zeros((width, len(blocks)), np.int32)
        for lane, i in enumerate(order.tolist()):
            raw[: len(blocks[i]), lane] = blocks[i]
        lens = np.array([len(blocks[i]) for i in order])
        alive = np.searchsorted(-lens, -np.arange(width), side="left")  # lanes with a character at each step
        before = np.full(len(blocks), -1, np.int64)  # the lane that a lane continues
        for i in np.flatnonzero(continues if continues is not None else np.zeros(len(blocks), bool)):
            before[lane_of[i]] = lane_of[i - 1]
        after = np.full(len(blocks), -1, np.int64)
        after[before[before >= 0]] = np.flatnonzero(before >= 0)
        out = np.empty((len(blocks), len(self.langs)), np.int64)
        for k, machine in enumerate(self.machines):
            lanes = machine.local[raw]
            walk = np.zeros_like(lanes)
            end = np.zeros(len(blocks), np.int32)
            count = np.zeros(len(blocks), np.int64)
            for t, n in enumerate(alive.tolist()):
                s = machine.step(end[:n], lanes[t, :n])
                walk[t, :n] = s
                count[:n] += s >> 30
                end[:n] = s & ~FLAG
            todo = np.flatnonzero(before >= 0)
            while len(todo):
                todo = self._again(machine, lanes, lens, walk, end, count, todo, end[before[todo]], after)
            out[order, k] = count
        return out

    @staticmethod
    def _again(machine: Machine, lanes, lens, walk, end, count, todo, state, after) -> np.ndarray:
        """Walk the lanes from other first states; the lanes that continue one whose last state changes."""
        changed = []
        for t in range(len(lanes)):
            s, old = machine.step(state, lanes[t, todo]), walk[t, todo]
            count[todo] += (s >> 30) - (old >> 30)
            walk[t, todo] = s
            state = s & ~FLAG
            apart = state != old & ~FLAG
            last = apart & (lens[todo] == t + 1)
            if last.any():
                end[todo[last]] = state[last]
                changed.append(after[todo[last]])
            on = apart & ~last
            todo, state = todo[on], state[on]
            if not len(todo):
                break
        following = np.concatenate(changed) if changed else np.zeros(0, np.int64)
        return following[following >= 0]

    def codes(self, text: str) -> tuple[np.ndarray, int]:
        """Codes with one space for runs of others, and the number of letters."""
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        if len(points) and points.max() >= 0x3000 or "İ" in text:
            plain = normalised(text)
            codes = np.fromiter((self.code.get(c, 0) for c in plain), np.int32, len(plain))
            return codes, len(plain) - plain.count(" ")
        codes = self.plain[points]
        space = self.is_space[points]
        keep = ~space
        keep[1:] |= space[1:] & ~space[:-1]
        n = int((~space).sum())
        if n and space[-1]:  # the space after the last letter
            keep[np.flatnonzero(~space)[-1] + 1 :] = False
        return codes[keep], n

    def predict(self, texts: Sequence[str | None], block: int = BLOCK) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.langs:
            return out
        coded = [self.codes(t) if t else (np.zeros(0, np.int32), 0) for t in texts]
        live = [i for i, (c, n) in enumerate(coded) if n]
        for s, e in groups_by_size([len(coded[i][0]) for i in live], 1 << 22):
            blocks, owner, continues = [], [], []
            for i in live[s:e]:
                c = coded[i][0]
                parts = [c[a : a + block] for a in range(0, len(c), block)]
                blocks += parts
                owner += [i] * len(parts)
                continues += [False] + [True] * (len(parts) - 1)
            found = self.phrases(blocks, continues)
            where = np.array(owner)
            for_doc, at = np.unique(where, return_inverse=True)
            sums = np.zeros((len(for_doc), len(self.langs)), np.int64)
            np.add.at(sums, at, found)
            for i, phrases in zip(for_doc.tolist(), sums):
                rates = phrases * self.weight / len(coded[i][0])
                best = int(rates.argmin())
                rest = np.delete(rates, best)
                score = 1.0 if not len(rest) else 1.0 - float(rates[best] / rest.min())
                out[i] = (self.langs[best], score)
        return out


def predict(docs: DataFrame, **bounds) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``."""
    model = json.dumps(training_texts(docs, **bounds), sort_keys=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = loaded(CrossParser, model)
        for b in batches:
            found = parser.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    slim = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    return predict(spark.read.parquet(f"{sf_dir}/documents.parquet"))
