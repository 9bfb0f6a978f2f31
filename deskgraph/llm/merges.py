"""A byte-level BPE vocabulary as ranks, which encodes the same ids several times faster.

An encoder over ranks joins any two neighbours whose bytes together are a token; the tokenizer only those that its list of merges
names.  They give the same ids if ids follow the order of merges and every token's own bytes come out as that token: then no
two neighbours but those of its merge can ever stand there in its place.  Tokens that do not come out as themselves
can never be made, so they are left out.  What does not fit this has no ranks.
"""

from __future__ import annotations

import json

#: The split pattern that byte-level vocabularies of this kind are published with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Stands for the end of a word where a vocabulary marks it; a byte that no token has in it.
END = "\x00"


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def ranked(tokenizer, path: str, pattern: str = PATTERN):
    """A ``tiktoken`` encoding with the ids of ``tokenizer``, which was read from ``path``; None if it has no such ranks.

    With a suffix for the ends of words, every word to encode has to end in ``END``.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    letters, suffix = byte_letters(), model.get("end_of_word_suffix") or ""
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    base = 512 if suffix else 256
    if any(model["vocab"].get("".join(m)) != base + k for k, m in enumerate(merges)) or model.get("ignore_merges") or model.get("dropout"):
        return None
    ranks = {}
    for name, i in model["vocab"].items():
        if i >= base + len(merges):
            continue  # special tokens
        ended = bool(suffix) and name.endswith(suffix)
        body = name.removesuffix(suffix) if ended else name
        if not body or any(c not in letters for c in body):
            return None
        raw = bytes(letters[c] for c in body)
        if suffix and len(raw) > 1 and 0 in raw:
            return None
        # a token inside a word is shown to the model with a letter after it, so that its end is not the word's
        made = tokenizer.model.tokenize(body) if ended or not suffix else None
        if len(raw) == 1 or made is None or [t.id for t in made] == [i]:
            ranks[raw + END.encode() * ended] = i
    if suffix:
        inner = {b for b in ranks if not b.endswith(END.encode())}
        if not _reachable(ranks, inner, merges, letters, suffix):
            return None
    return tiktoken.Encoding("ranks", pat_str=f"[^{END}]+{END}" if suffix else pattern, mergeable_ranks=ranks, special_tokens={})


def _reachable(ranks: dict[bytes, int], inner: set[bytes], merges: list[list[str]], letters: dict[str, int], suffix: str) -> bool:
    """Whether each token inside words is what joining its bytes in the order of merges gives."""
    order = {(a, b): k for k, (a, b) in enumerate(merges) if not b.endswith(suffix)}
    names = {b: c for c, b in letters.items()}
    for raw in inner:
        parts = [names[b] for b in raw]
        while len(parts) > 1:
            place = min(range(len(parts) - 1), key=lambda i: order.get((parts[i], parts[i + 1]), len(merges)))
            if (parts[place], parts[place + 1]) not in order:
                return False
            parts[place : place + 2] = [parts[place] + parts[place + 1]]
    return True
