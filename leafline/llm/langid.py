"""Language identification by cross-parsing.

For each language a suffix automaton is built over a bounded sample of its
labelled text. A text is parsed greedily into longest substrings of that
sample, from its first letter to its last; the language whose sample needs the
fewest phrases wins. Transitions are kept in one table of those that exist, so
an alphabet of any size takes no more room. A batch of texts is parsed in blocks
at once: each block is parsed as if a phrase began with it, and where the parse
before it runs over the block's begin it is followed until both begin a phrase
at the same letter. From there on they are one, so the phrases are those of the
parse without blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafline.llm.linear import held_out
from leafline.llm.runtime import Sent, plus

#: Letters that are parsed one after the other while other blocks are, too.
BLOCK = 1024


def normal(text: str) -> str:
    """Lower case, each run of other signs than letters one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def spread(text: str, most: int, piece: int = 128) -> str:
    """At most ``most`` letters of ``text``, all of it or pieces from begin to end at even distances."""
    if len(text) <= most:
        return text
    n = max(1, most // (piece + 1))
    piece = min(piece, most)
    last = len(text) - piece
    return " ".join(text[x : x + piece] for x in (i * last // max(1, n - 1) for i in range(n)))


def automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``codes``, a dictionary a state; state 0 is the first."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


@dataclass(frozen=True)
class Model:
    """Languages, the letters known, and the transitions of all their automata.

    The transitions of a state lie at ``base[state] + code`` of ``table``, in
    places that those of others leave free: each is its own state and, in the
    lowest ``bits`` bits, the next. The first states have none there: ``first``
    has the state after a letter that begins a phrase, a row a language.
    """

    languages: list[str]
    letters: str
    roots: np.ndarray
    first: np.ndarray
    base: np.ndarray
    table: np.ndarray
    bits: int
    phrase_bits: np.ndarray


def interleaved(states: list[dict[int, int]], width: int, bits: int, tries: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Where each state's transitions begin, and the table they share, about as long as there are transitions.

    States of many transitions go first, each to the first of some free places
    where all fit, else to the end; those of one fill the gaps.
    """
    base, used, low = np.zeros(len(states), np.int64), bytearray(width), 0
    owners, targets, places = [], [], []
    for state in sorted(range(len(states)), key=lambda s: -len(states[s])):
        codes = sorted(states[state])
        if not codes:
            break
        at = used.find(0, low)
        for k in range(tries):
            if at < 0 or at + codes[-1] - codes[0] >= len(used):
                used.extend(bytes(max(width, len(used) // 4)))
                at = at if at >= 0 else used.find(0, low)
            if not any(used[at + c - codes[0]] for c in codes):
                break
            if len(codes) > 1 and k + 2 == tries:
                low = at
                at = len(used)
                used.extend(bytes(width))
            else:
                at = used.find(0, at + 1)
        for c in codes:
            used[at + c - codes[0]] = 1
        if len(codes) == 1:
            low = at
        base[state] = at - codes[0] + width  # so that no code leads before the table
        owners += [state] * len(codes)
        targets += [states[state][c] for c in codes]
        places += [int(base[state]) + c for c in codes]
    table = np.full(len(used) + 2 * width, -1, np.int64)
    table[places] = np.array(owners, np.int64) << bits | np.array(targets, np.int64)
    return base, table


def build(samples: dict[str, str]) -> Model:
    """A model of each language's normalised sample text."""
    languages = sorted(x for x in samples if samples[x])
    # code 0 is the space, 1 every letter in no sample
    letters = "".join(sorted({c for x in languages for c in samples[x]} - {" "}))
    code = {c: i + 2 for i, c in enumerate(letters)} | {" ": 0}
    width, roots, states = len(letters) + 2, [], []
    first = np.zeros((len(languages), width), np.int64)
    for k, language in enumerate(languages):
        step, root = automaton(np.array([code[c] for c in samples[language]], np.int64)), len(states)
        first[k] = root  # a letter in no sample of the language is a phrase of its own
        for c, to in step[0].items():
            first[k, c] = to + root
        states += [{}, *({c: to + root for c, to in found.items()} for found in step[1:])]
        roots.append(root)
    bits = max(1, len(states).bit_length())
    base, table = interleaved(states, width, bits)
    weights = np.array([math.log2(len(samples[x]) + 2) for x in languages])
    return Model(languages, letters, np.array(roots, np.int64), first, base, table, bits, weights)


class Parser:
    """Counts phrases of batches of texts with one model."""

    def __init__(self, model: Model):
        self.model, self.width = model, len(model.letters) + 2
        self.codes = np.zeros(0x110000, np.uint8 if self.width <= 256 else np.int32)
        for start in range(0, 0x110000, 0x1000):
            if start not in range(0xD800, 0xE000):
                for c in range(start, start + 0x1000):
                    if chr(c).isalpha():
                        self.codes[c] = 1
        for i, c in enumerate(model.letters):
            self.codes[ord(c)] = i + 2

    def step(self, language: np.ndarray, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where the letter begins a phrase."""
        m = self.model
        at = m.base.take(state)
        at += code
        to = m.table.take(at)
        begins = (to >> m.bits) != state
        to &= (1 << m.bits) - 1
        new = np.flatnonzero(begins)
        to[new] = m.first[language.take(new), code.take(new)]
        return to, begins

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each text after normalisation, and phrases by text and language."""
        n, langs = len(texts), len(self.model.languages)
        joined = "\n".join(x.lower().replace("\n", " ") for x in texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes, ends = self.codes[points], points == 10
        owner = np.cumsum(ends) - ends
        use = (codes != 0) | ends
        use[1:] |= (codes[1:] == 0) & ~ends[1:] & (codes[:-1] != 0)  # the first sign of a gap stays as its space
        letters = np.bincount(owner[codes != 0], minlength=n)
        keep = use & ~ends
        codes, owner = codes[keep].astype(np.int64), owner[keep]
        size = np.bincount(owner, minlength=n)
        total = np.zeros((n, langs))
        if not len(codes):
            return letters, total
        ends = np.cumsum(size)
        blocks = -(-size // BLOCK)
        text_of = np.repeat(np.arange(n), blocks)
        nth = np.arange(len(text_of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = (ends - size)[text_of] + nth * BLOCK
        stop = np.minimum(begin + BLOCK, ends[text_of])
        state, starts = self._blocks(codes, begin, stop)
        meet, extra, late = self._joined(codes, stop, ends[text_of], state, starts)
        upto = np.zeros((langs, len(codes) + 1), np.int32 if len(codes) < 1 << 31 else np.int64)
        np.cumsum(starts, axis=1, out=upto[:, 1:])
        where = (np.searchsorted(begin, meet, "right") - 1).tolist()
        opens, closes, first = upto[:, begin], upto[:, stop], (np.cumsum(blocks) - blocks).tolist()
        for i in np.flatnonzero(blocks).tolist():
            for k in range(langs):
                b, entry = first[i], opens[k, first[i]]
                while True:
                    total[i, k] += closes[k, b] - entry
                    if stop[b] == ends[i]:
                        break
                    if (k, b) in late:
                        at, more = self._followed(codes, k, *late[k, b], int(ends[i]), starts[k])
                        total[i, k] += extra[k, b] + more
                        b, entry = (int(np.searchsorted(begin, at, "right")) - 1, upto[k, at])
                    else:
                        at = meet[k, b]
                        total[i, k] += extra[k, b]
                        b, entry = where[k][b], upto[k, at]
                    if at == ends[i]:
                        break
        return letters, total

    def _blocks(self, codes: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each block parsed from its begin: the last states by language and block, and the letters that begin a phrase."""
        langs = len(self.model.languages)
        starts = np.zeros((langs, len(codes)), bool)
        order = np.argsort(begin - stop, kind="stable")
        begin, span = begin[order], (stop - begin)[order]
        state = np.repeat(self.model.roots[:, None], len(begin), 1)
        language = np.repeat(np.arange(langs)[:, None], len(begin), 1)
        alive = np.searchsorted(-span, -np.arange(int(span[0])), "left")  # blocks longer than t
        for t in range(int(span[0])):
            k = int(alive[t])
            at = begin[:k] + t
            to, new = self.step(language[:, :k].ravel(), state[:, :k].ravel(), np.tile(codes[at], langs))
            state[:, :k], starts[:, at] = to.reshape(langs, k), new.reshape(langs, k)
        out = np.empty_like(state)
        out[:, order] = state
        return out, starts

    def _joined(self, codes: np.ndarray, stop: np.ndarray, ends: np.ndarray, state: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
        """The parse of each block followed behind it: where it begins a phrase that a later block begins too, or the text ends, and how many it begins before.

        Those that find no such letter in a block's length are left in a dictionary with their place and state.
        """
        meet, extra = np.zeros(state.shape, np.int64), np.zeros(state.shape, np.int64)
        language, block = np.nonzero(np.broadcast_to(stop < ends, state.shape))
        at, now = stop[block], state[language, block]
        for _ in range(BLOCK):
            if not len(at):
                break
            now, new = self.step(language, now, codes[at])
            met = new & starts[language, at]
            new &= ~met
            extra[language[new], block[new]] += 1
            meet[language[met], block[met]] = at[met]
            at = at + 1
            over = ~met & (at == ends[block])
            meet[language[over], block[over]] = at[over]
            on = np.flatnonzero(~met & ~over)
            language, block, at, now = language[on], block[on], at[on], now[on]
        return meet, extra, {(int(k), int(b)): (int(s), int(x)) for k, b, s, x in zip(language, block, now, at, strict=True)}

    def _followed(self, codes: np.ndarray, language: int, state: int, at: int, end: int, starts: np.ndarray) -> tuple[int, int]:
        """As ``_joined`` for one parse at any length, a letter at a time."""
        m, more = self.model, 0
        mask = (1 << m.bits) - 1
        while at < end:
            code = codes.item(at)
            entry = m.table.item(m.base.item(state) + code)
            if entry >> m.bits == state:
                state = entry & mask
            elif starts[at]:
                return at, more
            else:
                more += 1
                state = m.first.item(language, code)
            at += 1
        return end, more


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_rows: int = 48, sample_chars: int = 40_000, most_languages: int | None = None, all_chars: int = 1_000_000) -> Model:
    """Fit on labelled texts of all languages, or of the ``most_languages`` commonest.

    A language adds ``sample_chars`` letters of ``sample_rows`` texts, and all of
    them together ``all_chars``, at most (or a letter each, if there are more
    languages): these bound the model. The texts are
    those first by a hash of id and text, so they don't depend on how rows are
    stored. Letters are shared evenly over the texts that a language has; where
    a text is longer than its share, pieces at even distances over all of it
    are taken.
    """
    labelled = docs.where(F.col(lang_col).isNotNull())
    counts = labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"))
    counts = (counts if most_languages is None else counts.orderBy(F.desc("n"), "lang").limit(most_languages)).collect()  # a row a language
    if not counts:
        return build({})
    budget = max(1, min(sample_chars, all_chars // len(counts)))
    most = {r["lang"]: 4 * -(-budget // min(sample_rows, r["n"])) for r in counts}
    # by far more rows than are used pass, as some are empty or repeated
    limits = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 8 * sample_rows / r["n"])) for r in counts], "lang string, share double")
    order = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit(8))
    rows = labelled.where(F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), order.alias("h"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(limits), "lang").where(F.pmod("h", F.lit(1 << 30)) <= F.col("share") * F.lit(1 << 30)).select("lang", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [spread(normal(text.as_py()), most[lang.as_py()]) for lang, text in zip(batch.column(0), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["lang", "h", "text"])

    given = rows.mapInArrow(run, "lang string, h long, text string").groupBy("lang", "h").agg(F.min("text").alias("text"))
    given = given.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= sample_rows)
    samples: dict[str, list[str]] = {}
    for r in sorted(given.select("lang", "r", "text").collect()):  # at most `sample_rows` a language, four times their share of letters
        samples.setdefault(r["lang"], []).append(r["text"])
    return build({lang: shared(texts, budget) for lang, texts in samples.items()})


def shared(texts: list[str], budget: int) -> str:
    """``texts`` in one, each with as many letters as the others where it has them, ``budget`` together."""
    share, left = [0] * len(texts), budget
    for k, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        share[i] = min(len(texts[i]), left // (len(texts) - k))
        left -= share[i]
    return " ".join(spread(text, n) for text, n in zip(texts, share, strict=True) if n)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``.

    ``und`` with score 0 where a text is null or has no letter, or no language
    was learned. The score is the winner's share when phrases are weighed as
    their coding cost, so it nears 1 as a text gets longer. Ties go to the
    language first by name. Other columns pass through untouched.
    """
    docs = docs.drop("lang_pred", "score")
    held = Sent(docs.sparkSession, model)
    schema = plus(docs.schema, lang_pred=T.StringType(), score=T.DoubleType())
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(held.value) if held.value.languages else None
        most_chars = max(10_000, min(1_000_000, 4_000_000 // max(1, len(held.value.languages))))  # each language has its own parse of a letter
        for batch in batches:
            texts = [x or "" for x in batch.column(text_at).to_pylist()]
            names, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
            start = 0
            while parser and start < len(texts):
                stop, chars = start, 0
                while stop < len(texts) and (stop == start or chars + len(texts[stop]) <= most_chars):
                    chars += len(texts[stop])
                    stop += 1
                letters, phrases = parser.phrases(texts[start:stop])
                cost = phrases * held.value.phrase_bits
                best = cost.argmin(1)
                share = 1 / np.exp2(np.minimum(cost.min(1)[:, None] - cost, 0) / 16).sum(1)
                some = letters > 0
                names[start:stop] = np.where(some, np.array(held.value.languages, object)[best], "und")
                scores[start:stop] = np.where(some, share, 0.0)
                start = stop
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows not held out and predict every row.

    Returns ``doc_id, held_out, lang_pred, score``. Null ids count as not held
    out. Repeated rows each get their result; extra columns are ignored.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = train(given.where(~held_out("doc_id")), "doc_id", "text", "lang")
    rows = given.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")
