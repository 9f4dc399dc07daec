"""SentencePiece ids of whole texts by backtracking over longest matches, and texts of ids."""

import heapq
import re
from functools import lru_cache
from itertools import chain, groupby
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwarden.llm.shared import whole

SPACE = "▁"
#: Entries that a worker remembers: encoded chunks of at most so many characters, token pairs.
CHUNKS, LONGEST, PAIRS = 400_000, 64, 300_000
#: Ids that are given back together, or those of one text.
TOGETHER = 1 << 19

#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, BYTE = 1, 2, 6


def merged(text, scores, edge=-1):
    """The pieces of ``text`` when the best-scored neighbours are joined first, the leftmost of
    equals, as long as two neighbours make a piece. None once a piece lies across ``edge``."""
    parts, size = list(text), len(text)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    waiting = [(-scores[pair], i, i + 1, pair) for i, pair in enumerate(map(
        "".join, zip(parts, parts[1:]))) if pair in scores]
    heapq.heapify(waiting)
    while waiting:
        _, left, right, joined = heapq.heappop(waiting)
        if parts[left] is None or after[left] != right or parts[left] + parts[right] != joined:
            continue
        end = after[right]
        if left < edge < left + len(joined):
            return None
        parts[left], parts[right], after[left] = joined, None, end
        if end < size:
            before[end] = left
            pair = joined + parts[end]
            if pair in scores:
                heapq.heappush(waiting, (-scores[pair], left, end, pair))
        start = before[left]
        if start >= 0:
            pair = parts[start] + joined
            if pair in scores:
                heapq.heappush(waiting, (-scores[pair], start, left, pair))
    return [p for p in parts if p is not None]


class MergeEncoder:
    """Exact ids of a merge-type model without merging whole texts.

    Merges inside one part of a text don't depend on what stands elsewhere as long as no merge
    crosses its edge. So a sequence of tokens is the model's if and only if merging the
    characters of each two neighbours gives these two again, and every prefix of a text has one
    such sequence. The encoder takes the longest token at each place, shorter ones where it
    doesn't fit its predecessor, and steps back from places where none does. Such a place is
    kept in a bitfield and never entered again, so the work is linear in the text.
    """

    def __init__(self, scores, ids, byte_ids, unknown):
        import ahocorasick
        self.scores, self.byte_ids, self.unknown = scores, byte_ids, unknown
        letters = {c for piece in scores for c in piece}
        self.tokens = [*scores, *sorted(letters - set(scores))]
        self.ids = [(ids[t],) if t in ids else self._bytes(t) for t in self.tokens]
        self.letters = letters
        self.nothing = len(self.tokens)  # stands before the first token
        self.tokens.append("")
        self.lengths = [len(t) for t in self.tokens]
        # the longest other token that each one begins with; -1 for none
        numbers = {t: i for i, t in enumerate(self.tokens[:-1])}
        self.shorter = [next((numbers[t[:n]] for n in range(len(t) - 1, 0, -1)
                              if t[:n] in numbers), -1) for t in self.tokens]
        # Read from its end, a text shows the tokens that begin at a place together, longest first.
        self.automaton = ahocorasick.Automaton()
        for number, token in enumerate(self.tokens[:-1]):
            self.automaton.add_word(token[::-1], number)
        self.automaton.make_automaton()
        self.chunks = re.compile(_chunks(scores))
        self.single = {t: i for t, i in zip(self.tokens, self.ids) if len(t) == 1}
        self.fits, self.known = {}, {}

    def _bytes(self, character):
        if self.byte_ids is None:
            return (self.unknown,)
        return tuple(self.byte_ids[b] for b in character.encode())

    def compatible(self, before, token):
        """Whether merging both texts together gives both tokens again."""
        first, second = self.tokens[before], self.tokens[token]
        parts = merged(first + second, self.scores, len(first))
        fits = parts == ([first, second] if first else [second])
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        self.fits[before * len(self.tokens) + token] = fits
        return fits

    def _run(self, text):
        """Numbers of the tokens of a text whose characters all occur in pieces."""
        size, lengths, shorter = len(text), self.lengths, self.shorter
        fits, many = self.fits, len(lengths)
        longest, seen = [-1] * size, size
        for end, number in self.automaton.iter(text[::-1]):
            if end != seen:  # the first that ends here is the longest
                longest[size - 1 - end], seen = number, end
        failed, any_failed = None, False
        taken, at, before, token = [], 0, self.nothing, longest[0]
        while True:
            end = at + lengths[token]
            if not (any_failed and failed[end >> 3] >> (end & 7) & 1):
                fit = fits.get(before * many + token)
                if self.compatible(before, token) if fit is None else fit:
                    taken.append(token)
                    if end == size:
                        return taken
                    at, before, token = end, token, longest[end]
                    continue
            token = shorter[token]
            while token < 0:  # nothing fits here: never come back, and go on one token before
                if not any_failed:
                    failed, any_failed = bytearray(size // 8 + 1), True
                failed[at >> 3] |= 1 << (at & 7)
                at -= lengths[before]
                token = shorter[taken.pop()]
                before = taken[-1] if taken else self.nothing

    def _chunk(self, text):
        if len(text) == 1 and text in self.single:
            return self.single[text]
        if self.letters.issuperset(text):
            return [i for token in self._run(text) for i in self.ids[token]]
        out = []
        for lettered, run in groupby(text, self.letters.__contains__):
            for part in ["".join(run)] if lettered else run:
                out += self._chunk(part) if lettered else self._bytes(part)
        return out

    def encode(self, text):
        """Ids of a whole text; its spaces become the space sign, one more stands before it."""
        if not text:
            return []
        chunks, known = self.chunks.findall(SPACE + text.replace(" ", SPACE)), self.known
        if len(known) >= CHUNKS:
            known.clear()
        new = set(chunks).difference(known)
        for chunk in new:
            known[chunk] = tuple(self._chunk(chunk))
        out = list(chain.from_iterable(map(known.__getitem__, chunks)))
        if self.byte_ids is None:  # neighbours without a piece are unknown together
            out = [i for n, i in enumerate(out) if i != self.unknown or out[n - 1:n] != [i]]
        for chunk in new:
            if len(chunk) > LONGEST:
                del known[chunk]
        return out


def _chunks(scores):
    """A pattern of chunks that no piece reaches over the edge of.

    Letters of a chunk belong to one set of those that pieces join, space signs stand before
    them, and a letter that no piece joins to another is a chunk.
    """
    joined = {}

    def of(letter):
        while joined.setdefault(letter, letter) != letter:
            letter = joined[letter]
        return letter

    for piece in scores:
        for a, b in zip(piece, piece[1:]):
            if a != SPACE and b == SPACE:
                return r"(?s).+"  # space signs may follow anything
            if SPACE not in (a, b) or a != b:
                joined[of(a if a != SPACE else b)] = of(b)
    sets = {}
    for letter in sorted(joined):
        sets.setdefault(of(letter), []).append(letter)
    kinds = sorted(map("".join, sets.values()), key=len, reverse=True)
    return "(?s)" + "|".join([*(f"{SPACE}*[{re.escape(k)}]+" for k in kinds), f"{SPACE}+", "."])


def model_path():
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def load(path):
    """The encoder of a model file, and the id that ends a text; once per Python worker."""
    from sentencepiece import sentencepiece_model_pb2 as formats
    model = formats.ModelProto()
    with open(path, "rb") as data:
        model.ParseFromString(data.read())
    rules = model.normalizer_spec
    if (model.trainer_spec.model_type != formats.TrainerSpec.BPE
            or rules.precompiled_charsmap or rules.remove_extra_whitespaces
            or not rules.add_dummy_prefix or not rules.escape_whitespaces
            or {p.type for p in model.pieces} - {NORMAL, UNKNOWN, BYTE, 3}):
        raise ValueError("not a merge-type model with texts taken as they are")
    normal = {p.piece: (p.score, i) for i, p in enumerate(model.pieces) if p.type == NORMAL}
    spelled = [i for i, p in enumerate(model.pieces) if p.type == BYTE]
    encoder = MergeEncoder(
        {p: s for p, (s, _) in normal.items()}, {p: i for p, (_, i) in normal.items()},
        spelled if model.trainer_spec.byte_fallback else None, model.trainer_spec.unk_id)
    return encoder, model.trainer_spec.eos_id


@lru_cache(maxsize=2)
def decoder(path):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=str(path))


def encode(docs: DataFrame, model=None, end=True, decoded=False) -> DataFrame:
    """docs with ids (array<int>) of the whole text, and with ``decoded`` the text decoded again.

    model: path of a SentencePiece model of merge type on every executor; the installed 32k one
    if not given. Ids are those of the library without sampling; ``end`` adds the id that ends a
    text. A null or empty text has no ids but that one. Memory is that of one batch of texts and
    the ids of one text; repeated rows are each returned; no rows give no rows.
    Columns that are called ids or decoded are replaced, others kept.
    """
    path = str(model or model_path())
    kind = "ids array<int>, decoded string" if decoded else "ids array<int>"

    @F.pandas_udf(kind)
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder, last = load(path)
        for texts in batches:
            found, back, size = [], [], 0
            for text in texts:
                ids = encoder.encode(text) + [last] * end
                found.append(np.array(ids, np.int32))
                if decoded:
                    back.append(decoder(path).decode(ids))
                size += len(ids)
                if size >= TOGETHER:
                    yield _frame(found, back)
                    found, back, size = [], [], 0
            if found:
                yield _frame(found, back)

    return docs.withColumn("_ids", ids_of(whole(F.col("text")))).select(
        *[c for c in docs.columns if c not in ("ids", "decoded")], "_ids.*")


def _frame(ids, decoded):
    return pd.DataFrame({"ids": ids, "decoded": decoded} if decoded else {"ids": ids})


def decode(rows: DataFrame, model=None) -> DataFrame:
    """rows (ids, others kept) with decoded, the text of the ids; null ids have an empty one."""
    path = str(model or model_path())

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        return pd.Series([decoder(path).decode([int(i) for i in one]) for one in ids], dtype=str)

    return rows.withColumn("decoded", text_of(F.coalesce("ids", F.array().cast("array<int>"))))
