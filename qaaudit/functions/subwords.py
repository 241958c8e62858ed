"""Token budgets by a tokenizer of the user's choice, over Arrow batches.

A tokenizer is an extension point: a function without arguments that gives a function from texts to the (start, end) code points
of their tokens.  It is called once in each Python worker, so that what it loads is not sent with every task.  Without one,
tokens are runs of characters that are no white space (``functions.text``).

Tokens take a hundred times the memory of their text, so those of a few texts only are held at a time, whatever the batch.
Texts, too, leave the Arrow batch a few at a time.

The functions of a task by one tokenizer share one reading of each batch.  The words of a byte-level tokenizer end at spaces, so
a worker remembers how many tokens stand between two spaces, and how many a word has, and gives the library what it has not met.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import partial
from itertools import accumulate, chain, islice
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.serializers import CloudPickleSerializer
from pyspark.sql import Column
from pyspark.sql import functions as F

Offsets = Callable[[list[str]], list[list[tuple[int, int]]]]
Maker = Callable[[], Offsets]

#: How many tokens, and from which end of a text.
Cut = tuple[int, str]

#: Texts are given to a tokenizer until they have so many characters together; a longer text goes alone.
GROUP_CHARS = 100_000
#: Tokenizers that a Python worker keeps.
KEPT = 2
#: Numbers of tokens are remembered for the latest strings of so many characters at most: so many, or twice so many, of them.
SHORT, REMEMBERED = 64, 150_000
#: Spaces with something else than white space beside them.
AT_SPACES = re.compile(r"(?<=\S) | (?=\S)")
#: Characters below are Latin or signs, and of the same kind in every version of Unicode.
LATIN_END = "\u0250"
_of_kind = {k: "".join(c for c in map(chr, range(ord(LATIN_END))) if unicodedata.category(c)[0] == k) for k in "LN"}
_white = r"\t-\r \x85\xa0"
#: The words of a byte-level tokenizer in Latin text.
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{W}{L}{N}]+|[{W}]+(?![^{W}])|[{W}]+".format(W=_white, **_of_kind))
#: The characters that such a tokenizer has for bytes, where they are not the same in Latin-1.
BYTES = {b: chr(256 + n) for n, b in enumerate([*range(33), *range(127, 161), 173])}
KINDS = {"long": pa.int64(), "string": pa.string()}


def _groups(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    group, size = [], 0
    for text in texts:
        chars = len(text or "")
        if group and size + chars > GROUP_CHARS:
            yield group
            group, size = [], 0
        group.append(text)
        size += chars
    if group:
        yield group


class _Numbers:
    """Numbers of tokens of strings: of the latest short ones, and of all others until ``forget``."""

    def __init__(self) -> None:
        self.now: dict[str, int] = {}
        self.before: dict[str, int] = {}
        self.passing: list[str] = []

    def unknown(self, strings: set[str]) -> list[str]:
        new = strings.difference(self.now)
        old = new & self.before.keys()
        self.now.update((x, self.before[x]) for x in old)
        return list(new - old)

    def learn(self, strings: list[str], numbers: Iterable[int], keep: bool = True) -> None:
        self.now.update(zip(strings, numbers, strict=True))
        self.passing += [x for x in strings if not keep or len(x) > SHORT]

    def forget(self) -> None:
        for x in self.passing:
            del self.now[x]
        self.passing = []
        if len(self.now) > REMEMBERED:
            self.now, self.before = {}, self.now


class _ByteLevel:
    """A tokenizer whose words end before, or begin with, every space that has something else than white space beside it.

    Cut at such spaces, a text has the tokens of its first part and of each further part behind a space, every one on its own.
    """

    def __init__(self, library, spec: dict) -> None:
        self.library, self.added = library, [t["content"] for t in spec["added_tokens"]]
        vocab = library.get_vocab()
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)
        self.spaced[[i for token, i in vocab.items() if token.startswith(BYTES[ord(" ")])]] = True
        self.behind, self.alone, self.words = _Numbers(), _Numbers(), _Numbers()

    def __call__(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        return [e.offsets for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def places(self, texts: list[str], cuts: list[Cut | None]) -> list[list[int]]:
        """What ``_place`` gives, for each cut a list."""
        # tokens of the strings in which a cut may lie
        met: dict[str, list[tuple[int, int]]] = {}
        parts, counts = self._counted(texts, met if any(cuts) else None)
        for numbers in (self.behind, self.alone, self.words):
            numbers.forget()
        within: list[tuple[list[int], int, str, int, int]] = []
        found = [[sum(n) for n in counts] if cut is None else self._cut(cut, texts, parts, counts, within) for cut in cuts]
        strings = list({string for _, _, string, _, _ in within}.difference(met))
        met.update(zip(strings, self(strings), strict=True))
        for places, i, string, token, side in within:
            places[i] += met[string][token][side]
        return found

    def _counted(self, texts: list[str], met: dict[str, list[tuple[int, int]]] | None) -> tuple[list[list[str]], list[list[int]]]:
        """The parts of every text and their numbers of tokens; a text with an added token is one part.

        ``met`` gets the tokens of long strings that are given to the library on their own.
        """
        parts = [[t] if any(a in t for a in self.added) else t.split(" ") for t in texts]
        counts, new = self._looked_up(parts)
        # what is remembered ends with no white space
        odd = {p for p in new if not p or p[-1].isspace()}
        again = [i for i, p in enumerate(parts) if len(p) > 1 and (not p[0] or p[0][-1].isspace() or odd and not odd.isdisjoint(p[1:-1]))]
        if again:
            for i in again:
                parts[i] = AT_SPACES.split(texts[i])
            counts, new = self._looked_up(parts)
            odd = {p for p in new if not p or p[-1].isspace() or " " in p}
        plain = [p for p in new if p not in odd] if odd else new
        latin: list[str] = []
        others: list[str] = []
        for p in plain:
            (latin if p.isascii() or max(p) < LATIN_END else others).append(p)
        for some, count in ((latin, self._by_words), (others, self._joined)):
            for group in _groups(some):
                self.behind.learn(group, count(" " + " ".join(group)))
        alone = self.alone.unknown({p[0] for p in parts} | {" " + p for p in odd})
        if met is not None:
            long = [x for x in alone if len(x) > SHORT]
            met.update(zip(long, self(long), strict=True))
            self.alone.learn(long, map(len, met.values()))
            alone = [x for x in alone if len(x) <= SHORT]
        self.alone.learn(alone, [len(e) for e in self.library.encode_batch_fast(alone, add_special_tokens=False)])
        self.behind.learn([*odd], [self.alone.now[" " + p] for p in odd], keep=False)
        first, later = self.alone.now, self.behind.now
        return parts, [[first[p[0]], *[later[x] if m is None else m for x, m in zip(islice(p, 1, None), n, strict=True)]] for p, n in zip(parts, counts, strict=True)]

    def _looked_up(self, parts: list[list[str]]) -> tuple[list[list[int | None]], list[str]]:
        """Numbers of tokens of all parts but the first as far as they are at hand, and the parts that have none."""
        counts = [list(map(self.behind.now.get, islice(p, 1, None))) for p in parts]
        return counts, self.behind.unknown({x for p, n in zip(parts, counts, strict=True) for x, m in zip(islice(p, 1, None), n, strict=True) if m is None})

    def _joined(self, text: str) -> list[int]:
        """Numbers of tokens from each space up to the next one in a text with something else than white space before every space."""
        (e,) = self.library.encode_batch_fast([text], add_special_tokens=False)
        return np.diff(np.flatnonzero(self.spaced[e.ids]), append=len(e)).tolist()

    def _by_words(self, text: str) -> list[int]:
        """The same for a Latin text, by its words."""
        words, tokenize = WORDS.findall(text), self.library.model.tokenize
        new = self.words.unknown({*words})
        self.words.learn(new, [len(tokenize(w.encode().decode("latin-1").translate(BYTES))) for w in new])
        numbers = np.array([*map(self.words.now.__getitem__, words)])
        return np.add.reduceat(numbers, [i for i, w in enumerate(words) if w[0] == " "]).tolist()

    def _cut(self, cut: Cut, texts: list[str], parts: list[list[str]], counts: list[list[int]], within: list[tuple[list[int], int, str, int, int]]) -> list[int]:
        """Places of a cut; to those that lie within a string, the place in there is yet to be added."""
        k, keep = cut
        places: list[int] = []
        for text, p, n in zip(texts, parts, counts, strict=True):
            total = sum(n)
            if not 0 < k < total:
                places.append(_place(cut, text, range(total)))
                continue
            step = 1 if keep == "head" else -1
            j, over = next((j, m - k) for j, m in enumerate(accumulate(n[::step])) if m >= k)
            at = j if keep == "head" else len(p) - 1 - j
            string = " " + p[at] if at else p[at]
            # where the string begins, of which all tokens but ``over`` are kept
            begins = sum(map(len, p[:at])) + max(at - 1, 0) if keep == "head" else len(text) - len(string) - sum(map(len, p[at + 1 :])) - j
            if over:
                within.append((places, len(places), string, *((-1 - over, 1) if keep == "head" else (over, 0))))
            places.append(begins if over or keep == "tail" else begins + len(string))
        return places


def _cut_at_spaces(spec: dict) -> bool:
    """Is a text with that description's tokenizer cut at spaces, as ``_ByteLevel`` asks for, before all else?"""
    from tokenizers.pre_tokenizers import ByteLevel

    words, model = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, spec["model"]
    return (
        spec["normalizer"] is None
        and spec["post_processor"] is None
        and words.items() <= (spec["pre_tokenizer"] or {}).items()
        and model["type"] == "BPE"
        and not any(model[c] for c in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        and model["vocab"].keys() >= set(ByteLevel.alphabet())
        and not any(" " in t["content"] for t in spec["added_tokens"])
    )


def _load(path: str, _: str) -> Offsets:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    if _cut_at_spaces(spec := json.loads(made.to_str())):
        return _ByteLevel(made, spec)
    return lambda texts: [e.offsets for e in made.encode_batch(texts, add_special_tokens=False)]


def tokenizer_file(path: str) -> Maker:
    """The tokenizer of a JSON file, without special tokens, truncation or padding; the file is read anew for every call."""
    return partial(_load, path, uuid.uuid4().hex)


def _place(cut: Cut | None, text: str, tokens: Sequence[tuple[int, int]]) -> int:
    """Where a cut lies in a text, between characters; without one the number of tokens."""
    if cut is None:
        return len(tokens)
    k, keep = cut
    if len(tokens) <= k:
        return len(text) if keep == "head" else 0
    if k <= 0:
        return 0 if keep == "head" else len(text)
    return tokens[k - 1][1] if keep == "head" else tokens[-k][0]


class _Reader:
    """A tokenizer, and what it found in the batch that it read last."""

    def __init__(self, tokens: Offsets) -> None:
        self.tokens, self.batch = tokens, None
        self.found: dict[Cut | None, list[int | None]] = {}
        self.asked: set[Cut | None] = set()

    def places(self, batch: pa.Array, cut: Cut | None, others: set[Cut | None]) -> list[int | None]:
        """``_place`` of every text.  A batch is read once for all that the one before was asked for, and for ``others``."""
        wanted = {cut}
        if self.batch is None or not batch.equals(self.batch):
            self.batch, self.found, self.asked, wanted = batch, {}, {cut}, self.asked | others | {cut}
        self.asked.add(cut)
        if cut not in self.found:
            cuts = list(wanted)
            made: list[list[int | None]] = [[] for _ in cuts]
            for group in _groups(text.as_py() for text in batch):
                known = [t for t in group if t is not None]
                for out, places in zip(made, self._of(known, cuts), strict=True):
                    following = iter(places)
                    out += [None if t is None else next(following) for t in group]
            self.found |= zip(cuts, made, strict=True)
        return self.found[cut]

    def _of(self, texts: list[str], cuts: list[Cut | None]) -> list[list[int]]:
        if places := getattr(self.tokens, "places", None):
            return places(texts, cuts)
        columns: list[list[int]] = [[] for _ in cuts]
        for text, tokens in zip(texts, self.tokens(texts), strict=True):
            for column, cut in zip(columns, cuts, strict=True):
                column.append(_place(cut, text, tokens))
        return columns


class _Kept(dict):
    """A dictionary that a Python worker has once: functions come there by value, and their copies of it are that one."""

    def __init__(self, name: str) -> None:
        self.name = name

    def __reduce__(self):
        return _of_worker, (self.name,)


def _of_worker(name: str) -> _Kept:
    holder = sys.modules.setdefault("qaaudit-kept", ModuleType("qaaudit-kept"))
    return vars(holder).setdefault(name, _Kept(name))


_kept: dict[str, _Reader] = _Kept("tokenizers")
#: What functions that have come to a worker will ask of a tokenizer.
_coming: dict[str, set[Cut | None]] = _Kept("asked")


class _Ask:
    """What a function asks of the tokenizer of a name.  A worker knows it as soon as the function has come there."""

    def __init__(self, name: str, make: Maker, cut: Cut | None) -> None:
        self.name, self.make, self.cut = name, make, cut

    def __reduce__(self):
        return _come, (self.name, self.make, self.cut)

    def places(self, batch: pa.Array) -> list[int | None]:
        return _made(self.name, self.make).places(batch, self.cut, _coming.pop(self.name, set()))


def _come(name: str, make: Maker, cut: Cut | None) -> _Ask:
    _coming.setdefault(name, set()).add(cut)
    while len(_coming) > KEPT:
        _coming.pop(next(iter(_coming)))
    return _Ask(name, make, cut)


def _made(name: str, make: Maker) -> _Reader:
    """The worker's tokenizer of that name.  Every task brings its own copy of ``make``, so the copy itself is no key."""
    if name not in _kept:
        while len(_kept) >= KEPT:
            _kept.pop(next(iter(_kept)))
        _kept[name] = _Reader(make())
    return _kept[name]


def _by_batch(make: Maker, kind: str, cut: Cut | None, of: Callable[[pa.Array, list[int | None]], Iterable[object]]) -> Callable[[Column], Column]:
    """A column function: ``of`` texts and their places; null stays null.

    One worker runs all such functions of a task.
    """
    ask = _Ask(hashlib.sha256(CloudPickleSerializer().dumps(make)).hexdigest(), make, cut)

    @F.arrow_udf(kind)
    def run(batch: pa.Array) -> pa.Array:
        return pa.array(of(batch, ask.places(batch)), KINDS[kind])

    return run


def token_count(make: Maker) -> Callable[[Column], Column]:
    """Number of tokens of a whole text; in place of ``text.token_count``."""
    return _by_batch(make, "long", None, lambda batch, numbers: numbers)


def truncated(make: Maker, k: int, keep: str = "tail") -> Callable[[Column], Column]:
    """The last (or with ``keep='head'`` the first) ``k`` tokens of a text, cut where a token begins or ends.

    A text with no more than ``k`` tokens stays as it is.  Bytes of one character may lie in several tokens; a cut between them
    keeps the character.
    """
    if keep not in ("head", "tail"):
        raise ValueError(f"head or tail, not {keep!r}")
    part = slice if keep == "head" else lambda place: slice(place, None)

    def cut(batch: pa.Array, places: list[int | None]) -> Iterator[str | None]:
        return (None if at is None else text.as_py()[part(at)] for text, at in zip(batch, places, strict=True))

    return _by_batch(make, "string", (k, keep), cut)
