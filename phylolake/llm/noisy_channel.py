"""Restoring disguised words: Viterbi search in character lattices under a character language model.

A chunk of text (a written token, or a run of short tokens with their blanks) becomes a lattice:
signs and digits offer the letters they may stand for, a star any letter, a repeated letter or a sign may
be dropped, a separator may be dropped or end a word. The best way through the lattice under the
model of disguised words is compared with the plain reading under the model of the corpus.

The search is exact: histories are merged only where the model cannot tell them apart, no state is pruned, and chunks
have no length limit. Chunks whose lattice spells no word of the vocabulary keep their plain reading; this is decided
by running the lattice through the vocabulary's letter tree, which misses none.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

# Letters that digits and signs stand for in disguised words.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "#": "h", "%": "x",
}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
ORDER = 6  # letters of context taken from the vocabulary of disguised words
BETWEEN = 3  # letters of context outside the words of the vocabulary
CORPUS_ORDER = 2  # letters of context taken from the corpus
BACK_OFF = 0.3  # factor where the vocabulary has no word with the longer context
WHOLE_WORD = 3.0  # log-odds in favour of a word of the vocabulary
PRIOR = -8.0  # log-odds that a chunk is disguised
DOUBTFUL = -5.0  # restorations of lower log-odds are not offered to the classifier
WORD = re.compile("[a-z]+|[0-9]+")
RUN = re.compile(r"(?<!\S)\S{1,3}(?: \S{1,3})+(?!\S)")  # tokens of at most three characters may be pieces of one word
ORDINARY = re.compile(r"[a-z0-9 \-_.,:;?'\"/)\[\]]+")
PART = re.compile("[a-z0-9]+")
LEAD = re.compile("[a-z]*")
SPELLING = re.compile(r"[a-z*$@]")
TWICE = re.compile(r"([a-z])\1")

SIGNS = {c: [(x, -0.5) for x in letters] + ([] if c.isdigit() else [("", -1.5), (" ", -1.5)]) for c, letters in LEET.items()}
SIGNS["*"] = [("*", -1.0), ("", -1.5), (" ", -1.5)]
OTHER_LETTER, SEPARATOR = [("?", -1.0)], [("", -0.3), (" ", -0.1)]


class CharacterModel:
    """Letter probabilities: long contexts of a vocabulary mixed with short contexts of the corpus."""

    def __init__(self, vocabulary: dict[str, int], corpus_grams: dict[str, int], weight: float = 0.85):
        """``vocabulary`` gives each word with its weight among the disguised words, ``corpus_grams`` how often a run of three letters occurs."""
        self.weight = weight
        self.vocab: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        self.tree: dict = {}
        for w, often in vocabulary.items():
            padded = "^" + w + "$"
            for i in range(1, len(padded)):
                for k in range(0, min(ORDER, i) + 1):
                    self.vocab[padded[i - k : i]][padded[i]] += often
            node = self.tree
            for c in w:
                node = node.setdefault(c, {})
            node["$"] = True
        self.words = frozenset(vocabulary)
        self.beginnings = {("^" + w + "$")[: i + 1] for w in vocabulary for i in range(len(w) + 2)}
        self.onward: dict[str, list[str]] = defaultdict(list)  # letters that go on from the beginning of a word
        for b in sorted(self.beginnings):
            if len(b) > 1 and b[-1] != "$":
                self.onward[b[:-1]].append(b[-1])
        self.total = {c: sum(d.values()) for c, d in self.vocab.items()}
        self.corpus: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for g, n in corpus_grams.items():
            for k in range(CORPUS_ORDER + 1):
                self.corpus[g[CORPUS_ORDER - k : -1]][g[-1]] += n
        self.corpus_total = {c: sum(d.values()) for c, d in self.corpus.items()}
        self._step: dict[tuple[str, str], tuple[float, str]] = {}
        self._plain: dict[tuple[str, str], float] = {}

    def corpus_p(self, context: str, letter: str) -> float:
        p = 1 / 27
        for k in range(min(CORPUS_ORDER, len(context)) + 1):
            c = context[len(context) - k :]
            n = self.corpus_total.get(c)
            if n:
                p = (self.corpus[c].get(letter, 0) + 20 * p) / (n + 20)
        return p

    def step(self, state: str, letter: str) -> tuple[float, str]:
        """(log probability of the letter after a state, next state).

        A state that starts with '^' is the beginning of a word of the vocabulary; any other is the longest part of what
        was read that the model knows as a context. The end of a whole word of the vocabulary has a bonus.
        """
        key = (state, letter)
        got = self._step.get(key)
        if got is None:
            p, known = 1 / 27, state[-ORDER:]
            for k in range(0, len(known) + 1):
                c = known[len(known) - k :]
                n = self.total.get(c)
                if not n:
                    p *= BACK_OFF
                    break
                p = (self.vocab[c].get(letter, 0) + p) / (n + 1)
            p = math.log(self.weight * p + (1 - self.weight) * self.corpus_p(state, letter))
            new = state + letter
            if letter == "$":
                p += WHOLE_WORD if new in self.beginnings else 0.0
            elif new not in self.beginnings:
                new = new.lstrip("^")[-BETWEEN:]
                while len(new) > CORPUS_ORDER and new not in self.total:
                    new = new[1:]
            got = self._step[key] = (p, new)
        return got

    def plain(self, chunk: str) -> float:
        """Log probability of a chunk as ordinary text: words of the corpus, digits and signs."""
        total, context = 0.0, "^"
        for c in chunk + " ":
            if "a" <= c <= "z":
                key = (context, c)
            elif context == "^":
                total -= 3.0 if c.isdigit() else 1.0
                continue
            else:
                key = (context, "$")
            p = self._plain.get(key)
            if p is None:
                p = self._plain[key] = math.log(self.corpus_p(*key))
            total += p
            context = (context + c)[-CORPUS_ORDER:] if key[1] != "$" else "^"
            if key[1] == "$" and c.isdigit():
                total -= 3.0
        return total


def readings(chunk: str, i: int) -> list[tuple[str, float]]:
    """What character ``i`` may stand for, with the log cost: a letter, '' for nothing, ' ' for the end of a word, '*' for
    any letter that goes on in a word of the vocabulary."""
    c = chunk[i]
    if "a" <= c <= "z":
        if i and chunk[i - 1] == c:
            long = i > 1 and chunk[i - 2] == c or chunk[i + 1 : i + 2] == c
            return [(c, 0.0), ("", -0.3 if long else -2.5)]
        return [(c, 0.0)]
    if c == " ":
        apart = (i < 2 or chunk[i - 2] == " ") and (i + 2 >= len(chunk) or chunk[i + 2] == " ")  # between single characters
        return [("", -0.3 if apart else -2.5), (" ", -0.1)]
    return SIGNS.get(c) or (OTHER_LETTER if c.isalpha() else SEPARATOR)


def may_spell(chunk: str, tree: dict) -> bool:
    """Whether some way through the lattice has a word of the vocabulary between two ends of words."""
    ends = max((i for i, c in enumerate(chunk) if not c.isalnum()), default=-1)  # the last place where another word may begin
    nodes = [tree]
    for i in range(len(chunk)):
        new = []
        for letter, _ in readings(chunk, i):
            if letter == "":
                new += nodes
            elif letter == " ":
                for n in nodes:
                    if "$" in n:
                        return True
                new.append(tree)
            elif letter == "*":
                for n in nodes:
                    new += [to for x, to in n.items() if x != "$"]
            else:
                for n in nodes:
                    to = n.get(letter)
                    if to is not None:
                        new.append(to)
        if not new and i >= ends:
            return False
        nodes = list({id(n): n for n in new}.values()) if len(new) > 1 else new
    return any("$" in n for n in nodes)


def decode(chunk: str, model: CharacterModel) -> tuple[float, str]:
    """Most probable way through the lattice: (log probability, words)."""
    states = {"^": (0.0, "")}
    step = model.step
    for i in range(len(chunk)):
        ways = readings(chunk, i)
        new: dict[str, tuple[float, str]] = {}
        for state, (score, word) in states.items():
            for letter, cost in ways:
                if letter == "":
                    s, c, w = score + cost, state, word
                elif letter == " ":
                    if state == "^":
                        s, c, w = score + cost, state, word
                    else:
                        p, _ = step(state, "$")
                        s, c, w = score + cost + p, "^", word + " "
                elif letter == "*":
                    for x in model.onward.get(state, ()):
                        p, c = step(state, x)
                        old = new.get(c)
                        if old is None or score + cost + p > old[0]:
                            new[c] = (score + cost + p, word + x)
                    continue
                else:
                    p, c = step(state, letter)
                    s, w = score + cost + p, word + letter
                old = new.get(c)
                if old is None or s > old[0]:
                    new[c] = (s, w)
        states = new
    ends = ((s + (step(c, "$")[0] if c != "^" else 0.0), w) for c, (s, w) in states.items())
    return max(ends, default=(-math.inf, ""))


class Restorer:
    """Restores the disguised chunks of folded text; equal chunks are decoded once per task."""

    def __init__(self, model: CharacterModel, memory: int = 1_000_000):
        self.model, self.memory = model, memory
        self.seen: set[str] = set()
        self.found: dict[str, tuple[str, float]] = {}

    def chunk(self, chunk: str) -> tuple[str, float] | None:
        """(restored words, log-odds against the plain reading), or None where nothing is disguised."""
        if not may_spell(chunk, self.model.tree):
            return None
        score, words = decode(chunk, self.model)
        own = words.split()
        if own == WORD.findall(chunk) or not any(w in self.model.words for w in own):
            return None
        odds = score + PRIOR - self.model.plain(chunk)
        return (" ".join(own), odds) if odds > DOUBTFUL else None

    def _learn(self, chunks) -> None:
        if len(self.seen) > self.memory:
            self.seen.clear()
            self.found.clear()
        for c in set(chunks).difference(self.seen):
            self.seen.add(c)
            # plain letters without a repeat are a lattice with a single way; what has neither letters nor signs for them spells nothing
            if (not c.isalpha() or not c.isascii() or TWICE.search(c)) and SPELLING.search(c) and self._may_begin(c):
                got = self.chunk(c)
                if got:
                    self.found[c] = got

    def _may_begin(self, chunk: str) -> bool:
        """False where, seen from the first letters of its parts, no word of the vocabulary can begin in a chunk: a quick bound
        before :func:`may_spell`, which loses nothing."""
        known = self.model.beginnings
        if not ORDINARY.fullmatch(chunk):
            return True
        parts = PART.findall(chunk)
        if " " in chunk and chunk.replace(" ", "").isalpha():  # plain words: one of the vocabulary would have to span several of them
            for i in range(len(parts)):
                joined = "^" + parts[i]
                for part in parts[i + 1 :]:
                    if joined[-1] == part[0]:
                        return True
                    joined += part
                    if joined not in known:
                        break
                    if joined + "$" in known:
                        return True
            return bool(TWICE.search(chunk))
        for part in parts:
            lead = LEAD.match(part).group()
            if not lead or "^" + lead in known or TWICE.search(part):
                return True
        return False

    def sentence(self, folded: str) -> tuple[list[str], list[str] | None, float]:
        """(plain words, restored words or None where nothing is disguised, log-odds of the doubtful restorations, at most 0)."""
        plain, tokens = WORD.findall(folded), folded.split()
        text = " ".join(tokens)
        runs = RUN.findall(text)
        self._learn(tokens)
        self._learn(runs)
        found = self.found
        if found.keys().isdisjoint(tokens) and found.keys().isdisjoint(runs):
            return plain, None, 0.0
        doubt = [0.0]

        def restored(chunk: str) -> str:
            got = found.get(chunk)
            if got is None:
                return chunk
            doubt[0] += min(0.0, got[1])
            return got[0]

        text = RUN.sub(lambda m: restored(m.group(0)), text)
        return plain, WORD.findall(" ".join(restored(t) for t in text.split(" "))), doubt[0]
