"""Document statistics, computed for a run of documents at once."""

from __future__ import annotations

import numpy as np

from .wordhash import Text, same_as_last, window_hashes


def _mask(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


SYMBOL = _mask("#*$%&|<>")
UPPER = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTER = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LETTER[0xC3:0xF5] = True  # lead bytes of letters beyond ASCII
DIGIT = _mask("0123456789")
EXCLAIM = _mask("!?")
STOP_MARK = _mask(".,;:")
CONT = np.zeros(256, bool)
CONT[0x80:0xC0] = True


def base_counts(text: Text) -> dict[str, np.ndarray]:
    """Per document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all int64).

    n_dup_lines counts lines with a word that equal an earlier line; n_repeat_words counts the words that lie in a
    window of three words found twice or more in the document, its first occurrence included.
    """
    starts, ends, doc = text.words()
    n, raw = text.n_docs, text.raw
    chars = np.concatenate([[0], np.cumsum(~CONT[raw], dtype=np.int64)])
    word_chars = np.bincount(doc, weights=chars[ends] - chars[starts], minlength=n).astype(np.int64)
    l_start, l_end, l_doc = text.lines()
    first = np.searchsorted(starts, l_start)
    has_word = np.zeros(len(l_start), bool)
    ok = first < len(starts)
    has_word[ok] = starts[first[ok]] < l_end[ok]
    l_start, l_end, l_doc = l_start[has_word], l_end[has_word], l_doc[has_word]
    l_order, l_same = same_as_last(l_doc, text.hashes(l_start, l_end))
    h, at = window_hashes(text.word_hashes(), doc, 3)
    order, repeated = same_as_last(doc[at], h)
    repeated[:-1] |= repeated[1:]
    covered = np.zeros(len(doc), bool)
    hit = at[order[repeated]]
    for i in range(3):
        covered[hit + i] = True
    return {
        "n_words": np.bincount(doc, minlength=n).astype(np.int64),
        "word_chars": word_chars,
        "n_symbols": text.per_doc(SYMBOL[raw]),
        "n_dup_lines": np.bincount(l_doc[l_order[l_same]], minlength=n).astype(np.int64),
        "n_repeat_words": np.bincount(doc[covered], minlength=n).astype(np.int64),
    }


#: The columns of ``statistics``, in order.
STATISTICS = (
    "log_words", "word_length", "symbols_per_word", "dup_lines", "repeat_words", "upper", "letters", "digits",
    "exclaims_per_word", "stops_per_word", "distinct_words", "words_per_line", "top_word", "log_chars",
)


def statistics(text: Text) -> np.ndarray:
    """A float32 row of STATISTICS for each document; an empty document gets zeros."""
    base, raw, n = base_counts(text), text.raw, text.n_docs
    _, _, doc = text.words()
    words = np.maximum(base["n_words"], 1)
    chars = np.maximum(text.per_doc(~CONT[raw]), 1)
    letters = text.per_doc(LETTER[raw])
    h = text.word_hashes()
    order, same = same_as_last(doc, h)
    first = np.flatnonzero(~same)
    runs = np.diff(np.append(first, len(h)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, doc[order][first], runs)
    lines = text.per_doc(raw == 10) + 1
    out = np.stack(
        [
            np.log1p(base["n_words"]),
            base["word_chars"] / words,
            base["n_symbols"] / words,
            base["n_dup_lines"] / lines,
            base["n_repeat_words"] / words,
            text.per_doc(UPPER[raw]) / np.maximum(letters, 1),
            letters / chars,
            text.per_doc(DIGIT[raw]) / chars,
            text.per_doc(EXCLAIM[raw]) / words,
            text.per_doc(STOP_MARK[raw]) / words,
            np.bincount(doc[order][first], minlength=n) / words,
            base["n_words"] / lines,
            top / words,
            np.log1p(text.per_doc(~CONT[raw])),
        ],
        axis=1,
    ).astype(np.float32)
    out[base["n_words"] == 0] = 0
    return out
