"""A token counter compiled from a vocabulary: a deterministic transducer over characters.

The vocabulary is a sentencepiece BPE model with byte fallback and no normalisation. BPE has two
properties that make a transducer of it:

* the encoding of every prefix of a text ends in one token, which is the one token that fits the end of
  the prefix and may follow the last token of the prefix before it;
* two tokens may stand side by side when encoding their joined text gives just these two.

So a state has to remember where tokens that are still possible began (the suffixes of what was read that begin some
token, a chain of an Aho-Corasick automaton), the last token before each of these places, and how many tokens there were. A
transition emits the change in the number of tokens. A space after another character leads into the same state
from everywhere, as no token holds a space behind a letter; so does a character outside the vocabulary.

Transitions are compiled when first met, and kept in a table that is dropped when it outgrows its bound.

Texts are cut into chunks. A chunk's state map sends the state before it to the state behind it and a count: up to the
chunk's first synchronising character it depends on the state before, from there on it doesn't. Chunks all run
together, one character per step; then the maps of neighbours are composed pairwise, level by level, which is a
parallel scan that leaves one map per text.
"""

from __future__ import annotations

import numpy as np

from waybill.llm.arrow import as_text

SPACE = "▁"
_START = -1  # no token before: nothing joins over this place
_SHIFT, _BIAS = 64, 32


class Vocabulary:
    """Pieces and scores of a model; which tokens may follow each other."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.piece: list[str] = []
        self.id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.piece.append(piece)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.id[piece] = i
                self.score[piece] = model.get_score(i)
        reachable = {}  # token to the two it is joined of last, where BPE makes it at all
        for p in self.id:
            parts = self.merge(p)
            if len(parts) == 1:
                reachable[p] = self._halves(p)
        self.tokens = {p: self.id[p] for p in reachable}
        self.bigrams = {p[k:k + 2] for p in self.id for k in range(len(p) - 1)}
        self.characters = {c for p in self.tokens for c in p}
        # Every prefix of a token is a node; below it are the tokens it is a proper prefix of.
        self.nodes: dict[str, list[int]] = {"": []}
        for p, i in self.tokens.items():
            for k in range(1, len(p)):
                self.nodes.setdefault(p[:k], []).append(i)
        for p in self.tokens:
            self.nodes.setdefault(p, [])
        # The tokens a token ends (begins) with while it is joined, each with the score of the join that ends it.
        self._ending = {self.id[p]: self._spine(p, reachable, 1) for p in reachable}
        self._beginning = {self.id[p]: self._spine(p, reachable, 0) for p in reachable}
        self.forget()

    def forget(self):
        self._like: dict[tuple[str, int], int | None] = {}
        self._first: dict[tuple, int] = {}

    def remembered(self) -> int:
        return len(self._like) + len(self._first)

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """What the last join of a piece joins."""
        if len(piece) == 1:
            return None
        parts = self.merge(piece, 2)
        return parts[0], parts[1]

    def _spine(self, piece: str, halves: dict, side: int) -> list[tuple[str, float]]:
        """From a single character up: (token at that end, score of the join it goes into next)."""
        out = [(piece, float("-inf"))]
        while halves.get(out[-1][0]):
            whole = out[-1][0]
            out.append((halves[whole][side], self.score[whole]))
        return out[::-1]

    def merge(self, text: str, stop: int = 1) -> list[str]:
        """BPE of a short text: the best pair first, the leftmost of equals; until ``stop`` parts are left."""
        parts = list(text)
        score = self.score
        while len(parts) > stop:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: int, right: int) -> bool:
        """Whether two tokens may stand side by side: no join over the border comes first.

        The tokens at the border grow join by join, best score first; at each moment the pair at the border
        must be worth less than the next join that takes one of the two away.
        """
        a, b = self._ending[left], self._beginning[right]
        i = j = 0
        while True:
            (x, next_x), (y, next_y) = a[i], b[j]
            over = self.score.get(x + y)
            # Of equal joins the left one comes first.
            if over is not None and over > next_x and over >= next_y:
                return False
            if i + 1 == len(a) and j + 1 == len(b):
                return True
            if next_x >= next_y:
                i += 1
            else:
                j += 1

    #: Nodes with at most so many tokens below have their last tokens told apart by what may follow only.
    FEW = 60

    def like(self, node: str, left: int) -> int | None:
        """A token that stands for ``left`` before ``node``; None if no token below the node may follow."""
        below = self.nodes[node]
        if not below:
            return None
        if len(below) > self.FEW:
            return left
        key = (node, left)
        if key not in self._like:
            follows = self.follows
            mask = tuple([t for t in below if left == _START or follows(left, t)])
            self._like[key] = self._first.setdefault((node, mask), left) if mask else None
        return self._like[key]


class Transducer:
    #: Entries of the table, and remembered pairs, beyond which all is dropped and compiled anew.
    MOST = 40_000_000
    MOST_PAIRS = 1_000_000

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.class_of = np.full(0x110000, -1, np.int32)
        self._reset()

    def _reset(self):
        self.class_of[:] = -1
        self.characters: list[str | int] = [1, 2, 3, 4]  # outside the vocabulary, by bytes in UTF-8
        # A state: for each suffix that begins a token, longest first, (suffix, last token before it, tokens
        # read before it less tokens read so far). The empty suffix comes last.
        self.states = [(("", _START, 0),)]
        self.number = {self.states[0]: 0}
        self.table = np.full((1024, 128), -1, np.int32)

    def classes(self, codes: np.ndarray) -> np.ndarray:
        """The column of each character."""
        out = self.class_of[codes]
        if (out < 0).any():
            for code in np.unique(codes[out < 0]).tolist():
                char = chr(code)
                if char in self.vocabulary.characters:
                    self.class_of[code] = len(self.characters)
                    self.characters.append(char)
                else:
                    self.class_of[code] = (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
            while len(self.characters) > self.table.shape[1]:
                self.table = np.hstack([self.table, np.full_like(self.table, -1)])
            out = self.class_of[codes]
        return out

    def _compile(self, state: int, column: int) -> int:
        """The packed transition: next state, and the change in the number of tokens."""
        char = self.characters[column]
        if isinstance(char, int):
            return _BIAS + char
        v = self.vocabulary
        chain = self.states[state]
        token, change = -1, 0
        for suffix, left, before in chain:  # the token that the longer prefix ends in
            right = v.tokens.get(suffix + char)
            if right is None:
                continue
            apart = left == _START or (v.piece[left][-1] + (suffix + char)[0]) not in v.bigrams
            if apart or v.follows(left, right):
                token, change = right, before + 1
                break
        if token < 0:
            raise ValueError(f"no token ends {chain[0][0] + char!r}")
        follow = []
        for suffix, left, before in chain:
            if suffix + char in v.nodes:
                if left != _START and (v.piece[left][-1] + (suffix + char)[0]) not in v.bigrams:
                    left = _START
                left = v.like(suffix + char, left)
                if left is not None:
                    follow.append((suffix + char, left, before - change))
        follow.append(("", token, 0))
        key = tuple(follow)
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
            if number >= len(self.table):
                self.table = np.vstack([self.table, np.full_like(self.table, -1)])
        return number * _SHIFT + _BIAS + change

    def _run(self, columns: np.ndarray, start: np.ndarray, stop: np.ndarray,
             state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run all lanes together, a character per step: the states behind them, and their counts."""
        length = stop - start
        order = np.argsort(-length, kind="stable")
        at, now, count = start[order], state[order].astype(np.int64), np.zeros(len(order), np.int64)
        ends = np.sort(length)
        flat, width = self.table.ravel(), self.table.shape[1]
        for step in range(int(ends[-1]) if len(ends) else 0):
            live = len(ends) - int(np.searchsorted(ends, step, side="right"))
            where = now[:live] * width + columns[at[:live] + step]
            move = flat[where]
            if (missing := move < 0).any():
                for pair in np.unique(where[missing]).tolist():
                    s, c = divmod(pair, width)
                    packed = self._compile(s, c)
                    self.table[s, c] = packed
                flat = self.table.ravel()
                move = flat[where]
            now[:live] = move >> 6
            count[:live] += (move & 63) - _BIAS
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return now[back], count[back]

    def count(self, rows: list[bytes], chunk: int) -> np.ndarray:
        """Tokens of each text."""
        if self.table.size > self.MOST or self.vocabulary.remembered() > self.MOST_PAIRS:
            self.vocabulary.forget()
            self._reset()
        # The library puts a space before every text but the empty one; a space is ``SPACE``.
        decoded = [SPACE + as_text(r) if r else "" for r in rows]
        lengths = np.array([len(d) for d in decoded], np.int64)
        codes = np.frombuffer("".join(decoded).encode("utf-32-le"), np.uint32)
        codes = np.where(codes == 32, ord(SPACE), codes)
        columns = self.classes(codes)
        if not len(codes):
            return np.zeros(len(rows), np.int64)
        ends = np.cumsum(lengths)
        # Synchronising characters: a space behind another character, any character outside the vocabulary.
        space = codes == ord(SPACE)
        sync = space.copy()
        sync[1:] &= ~space[:-1]
        sync[(ends - lengths)[lengths > 0]] = True
        sync |= columns < 4
        places = np.flatnonzero(sync)

        chunks = -(-lengths // chunk)
        text = np.repeat(np.arange(len(rows)), chunks)
        inside = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        start = (ends - lengths)[text] + inside * chunk
        stop = np.minimum(start + chunk, ends[text])
        found = np.append(places, len(codes))[np.searchsorted(places, start)]
        first = np.minimum(found, stop)  # the head of a chunk is [start, first)
        synced = found < stop
        state, count = self._run(columns, first, stop, np.zeros(len(start), np.int64))

        while len(text) > 1 and (text[1:] == text[:-1]).any():
            # Pairs of neighbours within a text: the left at an even place of the text's list.
            place = np.arange(len(text)) - np.searchsorted(text, text)
            right = np.flatnonzero(place % 2 == 1)
            left = right - 1
            run = synced[left]
            a, b = left[run], right[run]
            behind, more = self._run(columns, start[b], first[b], state[a])
            count[a] += more + count[b]
            state[a] = np.where(synced[b], state[b], behind)
            # A left part that never synchronised is all head: its text is read with the right one's head.
            a, b = left[~run], right[~run]
            first[a], synced[a], state[a], count[a] = first[b], synced[b], state[b], count[b]
            stop[left] = stop[right]
            keep = place % 2 == 0
            text, start, stop = text[keep], start[keep], stop[keep]
            first, synced, state, count = first[keep], synced[keep], state[keep], count[keep]
        out = np.zeros(len(rows), np.int64)
        out[text] = count
        return out
