"""An existing SentencePiece vocabulary, and recursions over sorted words that share prefixes.

Pieces are kept with a space for the word mark (U+2581), so they match plain text, and a literal
U+2581 in a text is an unknown character like any other without a piece: it is spelt in bytes.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from os.path import commonprefix

#: What an unknown character costs below the lowest score.
UNKNOWN_PENALTY = 10.0


@dataclass
class Vocabulary:
    pieces: dict[str, int]  # text -> id, of the pieces that match text
    scores: list[float]  # by id
    byte_ids: list[int]  # by byte value
    spelling: list[bytes] = field(repr=False)  # by id, what a piece decodes to
    unknown_id: int = 0

    @classmethod
    def load(cls, model_file: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces, byte_ids, spelling = {}, [-1] * 256, []
        for i in range(len(model)):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                spelling.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                spelling.append(b"")
            else:
                pieces[piece.replace("▁", " ")] = i
                spelling.append(piece.replace("▁", " ").encode())
        return cls(pieces, [model.get_score(i) for i in range(len(model))], byte_ids, spelling, model.unk_id())

    def parts(self) -> tuple:
        """As plain values, which a broadcast can carry to workers without this package."""
        return self.pieces, self.scores, self.byte_ids, self.spelling, self.unknown_id

    @property
    def by_merges(self) -> bool:
        """Whether the scores are ranks of merges, which are whole numbers, instead of log probabilities."""
        return all(float(self.scores[i]).is_integer() for i in self.pieces.values())

    def crossing(self) -> list[str]:
        """Pieces that would cross the boundary before a space; without any, words can be treated one by one."""
        return [p for p in self.pieces if " " in p.lstrip(" ")]


def backward_trie(vocabulary: Vocabulary, scores: list[float]) -> dict:
    """Nested dicts over the reversed pieces; the key "" of a node holds (id, score)."""
    root: dict = {}
    for piece, i in vocabulary.pieces.items():
        node = root
        for c in reversed(piece):
            node = node.setdefault(c, {})
        node[""] = (i, scores[i])
    return root


class Viterbi:
    """Segmentations of words as the vocabulary's own model gives them, with the forward state of the word before kept.

    Called with sorted words, they form a trie that is walked depth first: the forward state of the
    prefix that a word shares with the one before stays on the stack, over calls as well. The state of
    a prefix is the last piece of its best path (and, for a unigram model, the path's score).

    Of a unigram model the best path has the highest sum of scores; of equal ones that whose last
    piece is longer wins, as in the library. Of a model of merges there is exactly one path that
    merging gives, and that can be found forward as well: a path is the one of merging if and only
    if each two neighbours are what merging makes of their own text. So the path of a prefix ends with
    the one piece that is compatible with the last piece of the path before it. Unknown characters
    are spelt in bytes.
    """

    #: Pairs of neighbours whose compatibility is remembered.
    REMEMBERED = 300_000

    def __init__(self, vocabulary: Vocabulary, by_merges: bool | None = None) -> None:
        self.vocabulary, self.trie = vocabulary, backward_trie(vocabulary, vocabulary.scores)
        self.by_merges = vocabulary.by_merges if by_merges is None else by_merges
        self.unknown = min(vocabulary.scores[i] for i in vocabulary.pieces.values()) - UNKNOWN_PENALTY
        self.spelt = {i: p for p, i in vocabulary.pieces.items()}
        self.compatible: dict[int, bool] = {}  # by (id of one + 2) * size + id of the other
        # by end of a prefix: id of the last piece (-1: an unknown character, -2: none), its length, score of the path
        self.last, self.width, self.best, self.before = array("i", [-2]), array("i", [0]), array("d", [0.0]), ""

    def __call__(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each word with the ids of its segmentation."""
        last, width, byte_ids = self.last, self.width, self.vocabulary.byte_ids
        extend = self._merged if self.by_merges else self._summed
        for word in words:
            shared = len(commonprefix((self.before, word)))
            del last[shared + 1 :], width[shared + 1 :], self.best[shared + 1 :]
            extend(word, shared)
            self.before, ids, end = word, [], len(word)
            while end:
                i, start = last[end], end - width[end]
                if i >= 0:
                    ids.append(i)
                else:
                    ids += [byte_ids[b] for b in reversed(word[start:end].encode())]
                end = start
            ids.reverse()
            yield word, ids

    def _summed(self, word: str, shared: int) -> None:
        best, last, width, pieces = self.best, self.last, self.width, self.vocabulary.pieces
        for end in range(shared + 1, len(word) + 1):
            top, at, start, node = None, (-1, 1), end, self.trie
            while start:
                start -= 1
                node = node.get(word[start])
                if node is None:
                    break
                found = node.get("")
                if found is not None and (top is None or best[start] + found[1] >= top):
                    top, at = best[start] + found[1], (found[0], end - start)
            if word[end - 1] not in pieces:
                score = best[end - 1] + self.unknown
                if top is None or score > top:
                    top, at = score, (-1, 1)
            best.append(top)
            last.append(at[0])
            width.append(at[1])

    def _merged(self, word: str, shared: int) -> None:
        last, width, known, size_ = self.last, self.width, self.compatible, len(self.vocabulary.scores)
        for end in range(shared + 1, len(word) + 1):
            i, size, start, node = -1, 1, end, self.trie
            while start:
                start -= 1
                node = node.get(word[start])
                if node is None:
                    break
                found = node.get("")
                if found is not None:
                    pair = (last[start] + 2) * size_ + found[0]
                    fits = known.get(pair)
                    if fits is None:
                        if len(known) >= self.REMEMBERED:
                            known.clear()
                        fits = known[pair] = self._fits(last[start], found[0])
                    if fits:
                        i, size = found[0], end - start
                        break
            last.append(i)
            width.append(size)
            self.best.append(0.0)

    def _fits(self, one: int, other: int) -> bool:
        """Does merging the text of the two pieces give the two pieces? one below 0 is no piece, and nothing merges with an unknown character."""
        left, right = self.spelt.get(one, ""), self.spelt[other]
        return merge(left + right, self.vocabulary) == ([left, right] if left else [right])


def merge(text: str, vocabulary: Vocabulary) -> list[str]:
    """The pieces of a short text by merging: of all neighbours the pair whose joined piece has the highest score, the first of equal ones."""
    pieces, scores, parts = vocabulary.pieces, vocabulary.scores, list(text)
    while True:
        top, at = None, -1
        for k in range(len(parts) - 1):
            i = pieces.get(parts[k] + parts[k + 1])
            if i is not None and (top is None or scores[i] > top):
                top, at = scores[i], k
        if at < 0:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Marginals:
    """Log probabilities of words, summed over all segmentations, by a forward recursion in log space; shared prefixes are reused as in Viterbi."""

    #: Characters of a word whose arcs are kept for the way back; those of longer ones are found again, so a character takes a few bytes.
    KEPT = 200

    def __init__(self, vocabulary: Vocabulary, log_p: list[float]) -> None:
        self.vocabulary, self.log_p, self.trie = vocabulary, log_p, backward_trie(vocabulary, log_p)
        self.forward, self.arcs, self.before = array("d", [0.0]), [[]], ""  # by end of a prefix

    def _into(self, word: str, end: int) -> list[tuple]:
        """The arcs that end there: log of the probability of the paths through it, start, id of the piece or list of ids."""
        forward, into, start, node = self.forward, [], end, self.trie
        while start:
            start -= 1
            node = node.get(word[start])
            if node is None:
                break
            found = node.get("")
            if found is not None:
                into.append((forward[start] + found[1], start, found[0]))
        if word[end - 1] not in self.vocabulary.pieces:
            spelt = [self.vocabulary.byte_ids[b] for b in word[end - 1].encode()]
            into.append((forward[end - 1] + sum([self.log_p[i] for i in spelt]), end - 1, spelt))
        return into

    def _extend(self, word: str) -> None:
        forward, arcs, exp, log = self.forward, self.arcs, math.exp, math.log
        shared = len(commonprefix((self.before, word)))
        del forward[shared + 1 :], arcs[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            into = self._into(word, end)
            if len(into) == 1:
                forward.append(into[0][0])
            else:
                top = max(into)[0] if type(into[-1][2]) is int else max(a[0] for a in into)
                forward.append(top + log(sum([exp(a[0] - top) for a in into])))
            if end < self.KEPT:
                arcs.append(into)
        self.before = word

    def __call__(self, words: Iterable[str]) -> Iterator[tuple[str, float]]:
        for word in words:
            self._extend(word)
            yield word, self.forward[-1]

    def expect(self, words: Iterable[str], counts: Iterable[int], uses: list[float]) -> None:
        """Add to uses how often each piece is expected in the segmentations of the words, each as often as its count: forward with the shared prefixes, then backward."""
        exp, forward, arcs = math.exp, self.forward, self.arcs
        for word, count in zip(words, counts):
            self._extend(word)
            share = array("d", bytes(8 * (len(word) + 1)))  # of the paths, how many come through here
            share[-1] = count
            for end in range(len(word), 0, -1):
                if whole := share[end]:
                    for term, start, ids in arcs[end] if end < len(arcs) else self._into(word, end):
                        part = whole * exp(term - forward[end])
                        share[start] += part
                        if type(ids) is int:
                            uses[ids] += part
                        else:
                            for i in ids:
                                uses[i] += part


def best_paths(words: Iterable[str], vocabulary: Vocabulary, by_merges: bool | None = None) -> Iterator[tuple[str, list[int]]]:
    return Viterbi(vocabulary, by_merges)(words)


def marginals(words: Iterable[str], vocabulary: Vocabulary, log_p: list[float]) -> Iterator[tuple[str, float]]:
    return Marginals(vocabulary, log_p)(words)
