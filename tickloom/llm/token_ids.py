"""Token ids of whole texts, every distinct piece of a text being encoded once.

A tokenizer cuts a text into pre-tokens and works on each alone, so the ids of a text are those of its
pieces as long as no pre-token crosses a cut. Cuts are made at single spaces and, within a word, between a
Latin letter and the ASCII marks that end the word; the tokenizers named below never cross either.

Most pieces are runs of letters up to U+00FF, or two of them with a line end between. Where the tokenizer's steps
before its model are known to make one pre-token of such a run, changing nothing but lower case and the signs for
bytes, it goes to the model at once: those steps take most of the time.
"""

from __future__ import annotations

import json
import os
import re
import string
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII marks without the apostrophe, which contractions join to letters.
MARKS = string.punctuation.replace("'", "")
#: Latin letters before U+0250, without the dotted capital I, whose lower case ends in a mark.
_LETTER = "[A-Za-zªµºÀ-ÖØ-öø-įı-ɏ]"
_STEM_AND_MARKS = rf"{_LETTER}[{re.escape(MARKS)}]+\z"
#: A worker keeps the ids of so many pieces; beyond, those go that were not seen for long.
KEPT_PIECES = 1_200_000
#: Texts are worked on in slices of about so many bytes, which bounds the arrays beside the ids.
SLICE_BYTES = 1 << 20
#: Texts handed to the tokenizer at once: what it returns takes a kilobyte or so for each, until the ids are out of it.
ENCODED_AT_ONCE = 2_000
#: Steps of a tokenizer, with their settings, that keep a run of letters up to U+00FF together.
_KEEPING = (
    {"type": "NFC"}, {"type": "Lowercase"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
)
#: How byte-level tokenizers write a space, a line end and the two bytes of each letter from U+00C0 on.
_SPACE, _LINE_END = "\u0120", "\u010a"
_SIGNS = {ord(sign): sign.encode() for sign in map(chr, range(0x80, 0x100))}
_BYTES = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE)]
_SIGNS = {sign: "".join(chr(256 + _BYTES.index(b)) if b in _BYTES else chr(b) for b in two) for sign, two in _SIGNS.items()}
#: A run of letters, the marks behind it and, in the next line, another run.
_OVER_LINES = re.compile(rf"( ?)([^\W\d_]+)([{re.escape(MARKS)}]*)\n([^\W\d_]+)")


class _Lists:
    """Lists of ids behind each other: list ``k`` is ``flat[begins[k]:begins[k + 1]]``."""

    def __init__(self, flat: np.ndarray, begins: np.ndarray) -> None:
        self.flat, self.begins = flat, begins

    @classmethod
    def of(cls, lists: list[bytes]) -> _Lists:
        lengths = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
        return cls(np.frombuffer(b"".join(lists), np.uint32), np.concatenate(([0], np.cumsum(lengths))))

    def __add__(self, other: _Lists) -> _Lists:
        begins = np.concatenate((self.begins, other.begins[1:] + self.begins[-1]))
        return _Lists(np.concatenate((self.flat, other.flat)), begins)

    def gather(self, codes: np.ndarray, bounds: np.ndarray) -> _Lists:
        """New lists, the ``k``-th made of the lists ``codes[bounds[k]:bounds[k + 1]]``."""
        each = np.diff(self.begins)[codes]
        ends = np.concatenate(([0], np.cumsum(each)))
        at = np.arange(ends[-1]) + np.repeat(self.begins[codes] - ends[:-1], each)
        return _Lists(self.flat[at], ends[bounds])


def _steps(config: dict | None, inner: str) -> list[dict]:
    """The steps of a normalizer or pre-tokenizer, without the setting that only shifts offsets."""
    if config is None:
        return []
    if config["type"] == "Sequence":
        return [step for one in config[inner] for step in _steps(one, inner)]
    return [{name: value for name, value in config.items() if name != "trim_offsets"}]


def _keep_letters(before: list[dict], cuts: list[dict], joined: bool) -> bool:
    """Whether the steps make one pre-token of a run of letters, with the space before it if they join it."""
    if any(step not in _KEEPING for step in before + cuts):
        return False
    return bool(cuts) and cuts[-1]["type"] == "ByteLevel" and not (joined and any(step["type"] == "Split" for step in cuts))


def _is_run(word: str) -> bool:
    return word.isalpha() and (word.isascii() or max(word) <= "\xff")


class Encoder:
    """``spaces`` tells what the tokenizer does with the space before a word.

    * ``"joined"``: it belongs to the word (byte-level BPE);
    * ``"dropped"``: it only separates words.

    The name of a special token inside a text gives that token, as the library does it, or is ordinary text with
    ``plain_names``. Ids come as ``uint32``.
    """

    def __init__(self, path: str, spaces: str, plain_names: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if spaces not in ("joined", "dropped"):
            raise ValueError(f"spaces is 'joined' or 'dropped', not {spaces!r}")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_names
        added = self.tokenizer.get_added_tokens_decoder().values()
        names = [token.content for token in added if token.content and not (plain_names and token.special)]
        #: Texts with such a name are encoded whole.
        self.names = "|".join(f"(?:{re.escape(name)})" for name in names)
        self.joined = spaces == "joined"
        config = json.loads(self.tokenizer.to_str())
        steps = [_steps(config["normalizer"], "normalizers"), _steps(config["pre_tokenizer"], "pretokenizers")]
        #: Whether runs of letters may go to the model, and whether in lower case.
        self.letters = _keep_letters(*steps, self.joined)
        self.lower = {"type": "Lowercase"} in steps[0]
        self.model = self.tokenizer.model
        # Pieces met since the last change, and those met before it.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def direct(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes, straight from the tokenizer."""
        found = []
        for at in range(0, len(texts), ENCODED_AT_ONCE):
            some = self.tokenizer.encode_batch_fast(texts[at : at + ENCODED_AT_ONCE], add_special_tokens=False)
            found += [array("I", one.ids).tobytes() for one in some]
        return found

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """The same as :meth:`direct` for pieces without names; runs of letters skip the steps before the model."""
        if not self.letters:
            return self.direct(pieces)
        found: list[bytes] = [b""] * len(pieces)
        rest, tokenize, run = [], self.model.tokenize, self._run
        for k, piece in enumerate(pieces):
            spaced = self.joined and piece[:1] == " "
            word = piece[1:] if spaced else piece
            if _is_run(word):
                found[k] = array("I", [one.id for one in tokenize(run(spaced, word))]).tobytes()
            elif (over := _OVER_LINES.fullmatch(piece)) and _is_run(over[2]) and _is_run(over[4]):
                line_end = (_LINE_END,) if self.joined else ()
                parts = (run(spaced, over[2]), *([over[3]] if over[3] else []), *line_end, run(False, over[4]))
                found[k] = array("I", [one.id for part in parts for one in tokenize(part)]).tobytes()
            else:
                rest.append(k)
        for k, ids in zip(rest, self.direct([pieces[k] for k in rest])):
            found[k] = ids
        return found

    def _run(self, spaced: bool, word: str) -> str:
        """A run of letters as the model gets it."""
        word = word.lower() if self.lower else word
        word = word if word.isascii() else word.translate(_SIGNS)
        return _SPACE + word if spaced else word

    def _looked_up(self, parts: list[str]) -> _Lists:
        """Ids of different parts. What the worker knows already is looked up."""
        found = list(map(self.known.get, parts))
        missing = []
        for k in [k for k, ids in enumerate(found) if ids is None]:
            ids = self.older.get(parts[k])
            if ids is None:
                missing.append(k)
            else:
                found[k] = self.known[parts[k]] = ids
        for k, ids in zip(missing, self._encoded([parts[k] for k in missing])):
            found[k] = self.known[parts[k]] = ids
        if len(self.known) > KEPT_PIECES // 2:
            self.known, self.older = {}, self.known
        return _Lists.of([b"", *found])

    def _of_pieces(self, pieces: pa.Array) -> _Lists:
        """Ids of each piece, put together from its stem and its marks."""
        split = pc.match_substring_regex(pieces, _STEM_AND_MARKS)
        stems = pc.if_else(split, pc.utf8_rtrim(pieces, MARKS), pieces)
        cut = pc.filter(pieces, split)
        marks = pc.replace_substring_regex(cut, rf"(?s)\A.*{_LETTER}", "")
        coded = pc.dictionary_encode(pa.concat_arrays([stems, marks]))
        codes = coded.indices.to_numpy().astype(np.int64) + 1
        # Two parts a piece; the second is the empty one, at place 0, where a piece was not cut.
        both = np.zeros((len(pieces), 2), np.int64)
        both[:, 0] = codes[: len(pieces)]
        both[split.to_numpy(zero_copy_only=False), 1] = codes[len(pieces) :]
        # By way of numpy, as pyarrow's own lists take ten times as long.
        parts = self._looked_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        return parts.gather(both.ravel(), np.arange(0, 2 * len(pieces) + 1, 2))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's begin (one more entry for the end)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = pc.binary_length(texts).to_numpy()
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES)) + 1
        found, bounds, at = [], [np.zeros(1, np.int64)], 0
        for lo, hi in zip([0, *cuts], [*cuts, len(texts)]):
            if lo < hi:
                own = self._slice(texts.slice(lo, hi - lo))
                found.append(own.flat)
                bounds.append(own.begins[1:] + at)
                at += len(own.flat)
        return (np.concatenate(found) if found else np.empty(0, np.uint32)), np.concatenate(bounds)

    def _slice(self, texts: pa.Array) -> _Lists:
        lists = pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        coded = pc.dictionary_encode(lists.flatten())
        codes = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary
        whole = np.zeros(len(texts), bool)
        if self.names:
            whole |= pc.match_substring_regex(texts, self.names, ignore_case=True).to_numpy(zero_copy_only=False)
        if self.joined:
            # Next to other white space a cut at a space is not safe.
            unsafe = pc.or_(pc.equal(words, ""), pc.not_equal(pc.utf8_trim_whitespace(words), words))
            whole |= np.add.reduceat(unsafe.to_numpy(zero_copy_only=False)[codes].astype(np.int64), bounds[:-1]) > 0
            # The first piece of a text has no space before it; it gets a code of its own.
            heads, head_codes = np.unique(codes[bounds[:-1]], return_inverse=True)
            codes[bounds[:-1]] = len(words) + head_codes
            spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), words, pa.scalar(" ", pa.large_string()))
            words = pa.concat_arrays([spaced, words.take(pa.array(heads))])
        table = self._of_pieces(words)
        if whole.any():
            rows = np.flatnonzero(whole)
            pieces = np.diff(bounds)
            keep = np.repeat(~whole, pieces)
            keep[bounds[rows]] = True
            codes[bounds[rows]] = len(words) + np.arange(len(rows))
            table = table + _Lists.of(self.direct(texts.take(pa.array(rows)).to_pylist()))
            codes = codes[keep]
            pieces[rows] = 1
            bounds = np.concatenate(([0], np.cumsum(pieces)))
        return table.gather(codes, bounds)


@lru_cache(maxsize=4)
def encoder(path: str, spaces: str, plain_names: bool = False) -> Encoder:
    """One encoder a worker process."""
    return Encoder(path, spaces, plain_names)


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after the ids of each text."""
    return np.insert(ids, bounds[1:], end_id).astype(np.uint32), bounds + np.arange(len(bounds))
