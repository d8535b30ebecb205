"""Toxicity of text that hides its words: noisy-channel deobfuscation, then a score of what is restored.

Each token is read through a channel: a character may stand for itself, for the letters that it looks like
(leetspeak), or for nothing (a sign between letters, or one more of a repeated letter). Single letters or look-alike signs in a row are
read together as well, and each gap between them may be an edge of words or nothing (spacing). That makes a lattice of letters and edges, and a Viterbi search finds the
likeliest path under a character trigram model of all documents. Only a token of letters alone, no two alike in a row, has one
path, itself; so has a token without any letter. Words cut into pieces of two letters and more are not put together.

The score is logistic in the restored words' evidence: words and beginnings of words that are much commoner in
toxic training texts. Labels are read for training rows only (crc32 of the id modulo 5 is not 0), at most
``TRAIN_ROWS`` of them, those with the smallest hash of their ids, which bounds the lexicon: an entry stands in ``LEAST_TOXIC`` of these rows at least. The character
model counts all documents: 28 * 28 * 28 numbers.

Null and empty texts, and texts without evidence, get the score of no evidence. Very long texts are read whole. Repeated rows score alike, as do texts with equal evidence. If
training rows are of one class or missing, there is no lexicon and all get the score of no evidence. A label that is
null is no label; of several labels of one id the largest counts. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, crc_mod5, small_batches, table, text_bytes

TRAIN_ROWS, LEAST_TOXIC, LEAST_EVIDENCE, LEAST_DIVERGENCE = 20_000, 4, 3.0, 8.0
STEMS = (4, 5)
KEPT, REMEMBERED = 200_000, 300_000
#: Half the characters from which a token is cut into pieces, the least of a piece, and the characters whose ways back are held at once.
LONG, PIECE, SPAN = 200, 32, 1024
#: States of the character model: a-z, 26 between tokens, 27 a letter beyond ASCII.
STATES, EDGE, OTHER = 28, 26, 27
#: The letters that a sign can look like.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
#: Natural logarithms of the channel's probabilities: a sign for a letter, another sign for nothing, a sign that looks like a letter for nothing, a letter said once more,
#: a gap for nothing, between single characters or beside more than one.
LOOK, NOTHING, UNSEEN, AGAIN, JOIN, JOIN_MORE = -1.5, -3.0, -8.0, -5.0, -1.0, -6.0
TRIM = ".,;:?!\"'()[]{}<>«»“”‘’…"
DOUBLE, DOUBLES, TRIPLE = re.compile(r"(.)\1"), re.compile(r"(?=(.)\1)"), re.compile(r"(.)\1\1")
LETTER = re.compile(r"[^\W\d_]")
MEANINGLESS = re.compile(r"[^\w \t" + re.escape("".join(LOOKS)) + "]+|_")
_SHORT = "(?:[^\\W\\d_]|[" + re.escape("".join(LOOKS)) + "])"
SPACED = re.compile(rf"(?<!\S){_SHORT}(?:[ \t]+{_SHORT}){{2,}}(?!\S)")

#: Codes of observed characters: 0-25 a-z, 26 another letter, 27 a sign that looks like nothing, then LOOKS; 61 a gap beside more than one character, 62 another gap; 63 past the end; 64 more if said again.
CODE = {chr(97 + i): i for i in range(26)} | {c: 28 + i for i, c in enumerate(LOOKS)}
GAP_MORE, GAP, PAST = 61, 62, 63


def channel() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code: up to two states that can emit it and the logarithms with which they do, and with which it stands for nothing."""
    said, emit, skip = np.full((128, 2), -1), np.full((128, 2), -np.inf, np.float32), np.full(128, -np.inf, np.float32)
    skip[64:] = AGAIN
    for again in (0, 64):
        for i in range(26):
            said[i + again, 0], emit[i + again, 0] = i, 0
        said[26 + again, 0], emit[26 + again, 0] = OTHER, 0
        said[[GAP_MORE + again, GAP + again], 0], emit[[GAP_MORE + again, GAP + again], 0] = EDGE, 0
        for c, letters in LOOKS.items():
            for k, x in enumerate(letters):
                said[CODE[c] + again, k], emit[CODE[c] + again, k] = ord(x) - 97, LOOK
        skip[27 + again] = NOTHING
        skip[28 + again : GAP_MORE + again] = UNSEEN
        skip[GAP_MORE + again], skip[GAP + again] = JOIN_MORE, JOIN
        skip[PAST + again] = 0
    return said, emit, skip


SAID, EMIT, SKIP = channel()


def observed(token: str) -> list[int]:
    """The codes of a token's characters."""
    out = []
    for j, c in enumerate(token):
        if c == " ":
            alone = (j < 2 or token[j - 2] == " ") and (j + 2 >= len(token) or token[j + 2] == " ")
            out.append(GAP if alone else GAP_MORE)
        else:
            out.append(CODE.get(c, 26 if c.isalpha() else 27) + 64 * (j > 0 and c == token[j - 1]))
    return out


def advanced(codes: np.ndarray, score: np.ndarray, to: np.ndarray, remember: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """The scores of all states after the codes, and with remember the letter before last of each step's best way (-1: a character stood for nothing)."""
    n, width = codes.shape
    came = np.full((width, n, STATES, STATES), -1, np.int8) if remember else None
    for j in range(width):
        after = score + SKIP[codes[:, j]][:, None, None]
        for k in (0, 1):
            rows = np.flatnonzero(SAID[codes[:, j], k] >= 0)
            if len(rows):
                x = SAID[codes[rows, j], k]
                steps = score[rows] + to[x]
                best = steps.argmax(1)
                value = np.take_along_axis(steps, best[:, None, :], 1)[:, 0] + EMIT[codes[rows, j], k][:, None]
                better = value > after[rows, :, x]
                after[rows, :, x] = np.where(better, value, after[rows, :, x])
                if remember:
                    came[j, rows, :, x] = np.where(better, best, came[j, rows, :, x])
        score = after
    return score, came


def viterbi(tokens: list[str], model: np.ndarray, codes: list[np.ndarray] | None = None, begin: np.ndarray | None = None, ends: bool = True) -> list[str]:
    """The likeliest letters (and edges) of each token, all of like length at once. A state is the last two letters.

    Ways back are held for ``SPAN`` characters at a time: scores are kept at the spans' edges, and a span is gone through once more on the way back. begin has the states that
    tokens begin in, if not at an edge; without ends they do not end at an edge either."""
    n, width = len(tokens), max(map(len, tokens))
    table = np.full((n, width), PAST)
    for i, t in enumerate(tokens):
        table[i, : len(t)] = observed(t) if codes is None else codes[i]
    to = np.ascontiguousarray(model.transpose(2, 0, 1))  # by the next letter
    score = np.full((n, STATES, STATES), -np.inf, np.float32)
    rows = np.arange(n)
    if begin is None:
        score[:, EDGE, EDGE] = 0
    else:
        score[rows, begin[:, 0], begin[:, 1]] = 0
    cuts = list(range(0, width, SPAN))
    held = [score]
    for at in cuts[:-1]:
        held.append(advanced(table[:, at : at + SPAN], held[-1], to, False)[0])
    last, came = advanced(table[:, cuts[-1] :], held[-1], to, True)
    at = (last + model[:, :, EDGE] if ends else last).reshape(n, -1).argmax(1)
    a, b = at // STATES, at % STATES
    out = [[] for _ in range(n)]
    for c in reversed(range(len(cuts))):
        if c < len(cuts) - 1:
            came = advanced(table[:, cuts[c] : cuts[c] + SPAN], held[c], to, True)[1]
        held[c] = None
        for j in range(len(came) - 1, -1, -1):
            back = came[j, rows, a, b]
            for i in np.flatnonzero(back >= 0):
                out[i].append(tokens[i][cuts[c] + j] if b[i] == OTHER else " " if b[i] == EDGE else chr(97 + b[i]))
            a, b = np.where(back >= 0, back, a), np.where(back >= 0, a, b)
    return ["".join(reversed(x)) for x in out]


def long_viterbi(token: str, model: np.ndarray) -> str:
    """A long token's likeliest letters: two letters in a row that are said once each leave one state, so that the token is cut behind them, and its pieces are read together."""
    codes = np.asarray(observed(token))
    sure = codes <= OTHER - 1  # a-z and letters beyond ASCII that are not said again: one way to read them
    cut = np.flatnonzero(sure[1:] & sure[:-1]) + 2
    cut = cut[cut < len(codes)]
    kept, at = [], 0
    for c in cut.tolist():
        if c - at >= PIECE:
            kept.append(c)
            at = c
    bounds = [0, *kept, len(codes)]
    state = np.where(codes < 26, codes, OTHER)
    out = [""] * (len(bounds) - 1)
    inner = sorted(range(1, len(out) - 1), key=lambda i: bounds[i + 1] - bounds[i])
    groups = [[0]] + [[len(out) - 1]] * (len(out) > 1) if len(out) > 1 else [[0]]
    at = 0
    while at < len(inner):
        size = bounds[inner[at] + 1] - bounds[inner[at]]
        most = max(1, 800 * 64 // max(64, 2 * size))
        group = [i for i in inner[at : at + most] if bounds[i + 1] - bounds[i] <= 2 * size]
        groups.append(group)
        at += len(group)
    for group in groups:
        pieces = [token[bounds[i] : bounds[i + 1]] for i in group]
        begin = None if group[0] == 0 else np.array([[state[bounds[i] - 2], state[bounds[i] - 1]] for i in group])
        for i, said in zip(group, viterbi(pieces, model, [codes[bounds[i] : bounds[i + 1]] for i in group], begin, group[-1] == len(out) - 1)):
            out[i] = said
    return "".join(out)


def said_once(tokens: list[str], model: np.ndarray) -> list[str]:
    """The likeliest reading of tokens of letters alone, where each repeated letter counts or does not: all paths of such a lattice, scored outright."""
    words, owner, cost = [], [], []
    for i, t in enumerate(tokens):
        again = [j for j in range(1, len(t)) if t[j] == t[j - 1]]
        for chosen in range(1 << len(again)):
            gone = {j for b, j in enumerate(again) if chosen >> b & 1}
            words.append("".join(c for j, c in enumerate(t) if j not in gone) if gone else t)
            owner.append(i)
            cost.append(AGAIN * len(gone))
    size = np.array([len(w) for w in words])
    codes = np.full((len(words), size.max() + 3), EDGE)
    flat = np.array([CODE.get(c, 26) for c in "".join(words)])
    flat[flat >= 26] = OTHER
    inside = np.arange(codes.shape[1] - 3) < size[:, None]
    codes[:, 2:-1][inside] = flat
    step = model[codes[:, :-2], codes[:, 1:-1], codes[:, 2:]]
    total = np.where(np.arange(step.shape[1]) <= size[:, None], step, 0).sum(1) + np.array(cost)
    by = np.lexsort((-total, owner))
    best = by[np.r_[True, np.diff(np.array(owner)[by]) > 0]]
    return [words[k] for k in best]


def restore(tokens: list[str], model: np.ndarray) -> list[str]:
    """What the tokens (lower-case) say."""
    out = [t.strip(TRIM) for t in tokens]
    by: dict[int, list[int]] = {}
    plain: list[int] = []
    for i, (t, whole) in enumerate(zip(out, tokens)):
        if t.isalpha() and not DOUBLE.search(t) or not t:
            continue
        if t.isalpha() and len(DOUBLES.findall(t)) <= 3 and not TRIPLE.search(t):
            plain.append(i)
        elif LETTER.search(t):
            letters = MEANINGLESS.sub("", t)
            if letters.isalpha() and not DOUBLE.search(letters):  # its signs can only stand for nothing: one path
                out[i] = letters
                continue
            out[i] = whole.lstrip("\"'.,;:?").rstrip("\"'.,;:?!)") or whole  # signs that can be letters stay
            by.setdefault((len(out[i]) + 1) // 2, []).append(i)
    for k in range(0, len(plain), 2000):
        part = plain[k : k + 2000]
        for i, said in zip(part, said_once([out[i] for i in part], model)):
            out[i] = said
    for width, group in by.items():
        if width > LONG:
            for i in group:
                out[i] = long_viterbi(out[i], model) or out[i]
            continue
        step = max(1, 800 // width)
        for k in range(0, len(group), step):
            part = group[k : k + step]
            for i, said in zip(part, viterbi([out[i] for i in part], model)):
                out[i] = said or out[i]
    return out


def features(word: str) -> list[str]:
    """A word and its beginnings; of several words those of each."""
    return [f for w in word.split() for f in (w, *(f"{w[:n]}~" for n in STEMS if len(w) > n))]


def text_tokens(text: str | None) -> list[str]:
    """Lower-case tokens, and short ones in a row as one with gaps."""
    low = (text or "").lower()
    return low.split() + [" ".join(m.group().split()) for m in SPACED.finditer(low)]


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Natural logarithms of P(next | last two) over the 28 states, from all documents; contexts lean on the shorter ones where they are rare."""
    lut = np.full(256, EDGE)
    lut[97:123] = lut[65:91] = np.arange(26)
    lut[0xC0:] = OTHER

    def run(batches):
        total = np.zeros(STATES**3, np.int64)
        for b in chunks(batches, "_text"):
            buf, offsets = text_bytes(b.column(0))
            first = np.zeros(len(buf) + 1, bool)
            first[offsets] = True
            keep = (buf & 0xC0) != 0x80
            code, first = lut[buf[keep]], first[:-1][keep]
            last = np.r_[[EDGE], code[:-1]] if len(code) else code
            last = np.where(first, EDGE, last)
            before = np.r_[[EDGE], last[:-1]] if len(code) else code
            before = np.where(first | (last == EDGE), EDGE, before)  # nothing counts before an edge
            total += np.bincount((before * STATES + last) * STATES + code, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])

    got = docs.select(F.col(text).alias("_text")).mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    three = np.zeros((STATES,) * 3)
    for r in got:
        three.flat[r["pair"]] = r["n"]
    two = three.sum(0)
    one = (two.sum(0) + 1) / (two.sum() + STATES)
    two = (two + 10 * one) / (two.sum(1, keepdims=True) + 10)
    three = (three + 10 * two[None]) / (three.sum(2, keepdims=True) + 10)
    three[:, EDGE] = three[EDGE, EDGE]  # a state after an edge, whatever stood before it
    return np.log(three).astype(np.float32)


def training_rows(labels: DataFrame, key: str, most: int) -> DataFrame:
    """(key, _toxic): labelled rows outside the held-out fold, a bounded sample that does not depend on row order."""
    rows = labels.where("toxic is not null").where(F.col(key).isNotNull()).where(crc_mod5(key) != 0)
    return rows.groupBy(key).agg(F.max("toxic").alias("_toxic")).orderBy(F.xxhash64(key), key).limit(most)


def lexicon(training: DataFrame, text: str, model: np.ndarray) -> dict[str, float]:
    """Evidence (log of how much commoner in toxic texts) of words and beginnings."""
    n1, n0 = (training.agg(F.sum("_toxic")).first()[0] or 0), training.where("_toxic = 0").count()
    if not n1 or not n0:
        return {}

    def run(batches):
        held = {0: Counter(), 1: Counter()}
        for b in chunks(batches, "_text"):
            texts = [text_tokens(t) for t in b.column(0).to_pylist()]
            words = list({w for t in texts for w in t})
            said = dict(zip(words, map(features, restore(words, model))))
            for t, toxic in zip(texts, b.column(1).to_pylist()):
                held[int(toxic > 0)].update({f for w in set(t) for f in said[w]})
            if sum(map(len, held.values())) > KEPT:
                yield from out(held)
                held = {0: Counter(), 1: Counter()}
        yield from out(held)

    def out(held):
        for toxic, c in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([n if toxic else 0 for n in c.values()], pa.int64()), pa.array([0 if toxic else n for n in c.values()], pa.int64())], names=["feature", "n1", "n0"])

    counted = training.select(F.col(text).alias("_text"), "_toxic").mapInArrow(run, "feature string, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    evidence = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0))
    # A feature counts if its share of toxic texts is far from the rate of all (n times the divergence), so that chance ones do not.
    rate, n = n1 / (n1 + n0), F.col("n1") + F.col("n0")
    share = F.col("n1") / n
    far = n * (share * F.log(share / rate) + F.when(F.col("n0") > 0, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0))
    rows = counted.withColumn("evidence", evidence).where((F.col("n1") >= LEAST_TOXIC) & (F.col("evidence") >= LEAST_EVIDENCE)).where(far >= LEAST_DIVERGENCE).collect()  # few: LEAST_TOXIC of the training rows hold each
    return {r["feature"]: r["evidence"] for r in rows}


def evidence(docs: DataFrame, text: str, model: np.ndarray, words: dict[str, float]) -> DataFrame:
    """docs without the text, with _best, _sum and _hits: the strongest evidence of a word, that of all different words, and how many of them stand there."""
    shared = docs.sparkSession.sparkContext.broadcast((model, words))
    fields = [f for f in docs.schema.fields if f.name != text]
    names = [f.name for f in fields]

    def run(batches):
        model, words = shared.value
        known: set[str] = set()  # tokens met before
        telling: dict[str, float] = {}  # those of them with evidence
        for b in chunks(batches, text):
            texts = [set(text_tokens(t)) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            if len(known) > REMEMBERED:
                known, telling = set(), {}
            new = list(set().union(*texts) - known)
            known.update(new)
            for w, said in zip(new, restore(new, model)):
                value = max((words.get(f, 0.0) for f in features(said)), default=0.0)
                if value:
                    telling[w] = value
            found = [[telling[w] for w in t.intersection(telling)] for t in texts]
            best, total, hits = [max(x, default=0.0) for x in found], [float(sum(x)) for x in found], [float(len(x)) for x in found]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), *(pa.array(x, pa.float64()) for x in (best, total, hits))], names=[*names, "_best", "_sum", "_hits"])

    return docs.mapInArrow(run, T.StructType([*fields, *(T.StructField(n, T.DoubleType()) for n in ("_best", "_sum", "_hits"))]))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last is the constant) by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row: held_out, score (0 to 1) and predicted."""
    small_batches(docs.sparkSession)
    docs = docs.select(key, text)
    model = character_model(docs, text)
    training = docs.join(F.broadcast(training_rows(labels, key, train_rows)), key)
    words = lexicon(training, text, model)
    weights = np.array([0.0, 0.0, 0.0, -5.0])
    if words:
        rows = evidence(training, text, model, words).select("_best", F.log1p("_sum"), F.log1p("_hits"), "_toxic").toArrow()  # at most train_rows
        got = np.stack([c.to_numpy().astype(float) for c in rows.columns], 1)
        weights = logistic(got[:, :3], (got[:, 3] > 0).astype(float))
    line = F.lit(float(weights[3])) + weights[0] * F.col("_best") + weights[1] * F.log1p("_sum") + weights[2] * F.log1p("_hits")
    value = F.lit(1.0) / (1 + F.exp(-line))
    held = F.coalesce(crc_mod5(key), F.lit(1)) == 0
    out = evidence(docs, text, model, words).select(key, held.alias("held_out"), value.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
