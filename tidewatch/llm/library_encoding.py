"""Encoding as the tokenizers library does. A byte-level file whose ids are the order of its merges is read by tiktoken,
which gives the same ids in less time. For other files, and for texts with very long words, texts are cut at the special
strings and at white space, where merges can't reach across, and each distinct chunk is coded once and kept in a bounded
cache."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

from tidewatch.llm.pair_merges import PairMerges
from tidewatch.llm.pretokenize import WHITE_SPACE

_W = re.escape("".join(map(chr, WHITE_SPACE)))
#: Latin letters that no normaliser composes or splits; before a sign or white space a run of them is one piece.
_RUN = "[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[ \n.,;:!?|&*%$#]|\\Z)"
#: Chunks of byte-level texts: white space belongs to the ids, so a chunk is what the model's own pattern never crosses.
KEPT = re.compile(f" ?{_RUN}| ?[^{_W}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
#: For models that drop white space: any subset of it may cut, the rest stays inside a chunk for the library to drop.
DROPPED = re.compile(f"{_RUN}|[^ \n]+")
_PLAIN = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Characters of the chunks that a worker keeps, in two generations, and characters up to which chunks are kept; characters
#: of a word that is too long to be merged pair by pair.
CACHED, LONGEST, LONG = 5_000_000, 64, 1000
NONE: frozenset = frozenset()


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones are themselves, the rest
    follow from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class LibraryEncoder:
    """`drops_space`: whether the model's normaliser and splitter drop white space and case. `special_is_text`: special
    tokens' strings in a text are text like any other; else each is one id, as the library's default has it."""

    def __init__(self, path: str, drops_space: bool, special_is_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = PairMerges(path)  # for runs of letters, which normaliser and splitter leave whole
        #: Strings that the library takes out of a text before anything else; each is one id.
        self.special = [] if special_is_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.encode_special_tokens = special_is_text
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.find = (DROPPED if drops_space else KEPT).findall
        self.drops_space, self.cache, self.old, self.held = drops_space, {}, {}, 0
        self.ranks = None if drops_space else self._by_rank(path)

    def _by_rank(self, path: str):
        """A tiktoken encoding of the file, if the ids of its tokens rank its merges and it splits by the usual pattern."""
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, split = file["model"], file.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not model.get("ignore_merges") and not file.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
        vocab, special = model.get("vocab", {}), {t["content"]: t["id"] for t in file.get("added_tokens", ())}
        if not plain or any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(pairs)):
            return None
        of = byte_of()
        ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if t not in special}
        if len(ranks) != 256 + len(pairs) or any(ranks.get(bytes([b]), 256) > 255 for b in range(256)):
            return None
        return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={} if not self.special else special)

    def _chunks(self, text: str) -> list[str]:
        if not any(s in text for s in self.special):
            return self.find(text)
        parts = self.cut.split(text)  # every other one is a special string
        return [c for k, part in enumerate(parts) for c in ([part] if k % 2 else self.find(part))]

    def _coded(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks: runs of letters by their pair merges, all others by the library."""
        plain = [c for c in chunks if len(c) <= LONGEST and _PLAIN.fullmatch(c)]
        rest = list(set(chunks).difference(plain))
        found = dict(zip(plain, self.merges.encode([c.lower() for c in plain] if self.drops_space else plain)))
        found.update(zip(rest, (array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, without special tokens around it."""
        if not self.ranks:
            return self._by_chunks(texts)
        # Words beyond LONG letters would take tiktoken the square of their length.
        slow = [k for k, t in enumerate(texts) if len(t) > LONG and max(map(len, t.split()), default=len(t)) > LONG or len(t) > LONG and t.isspace()]
        later = dict(zip(slow, self._by_chunks([texts[k] for k in slow])))
        code, known = self.ranks.encode_to_numpy, set(self.special)
        return [later[k] if k in later else code(t, allowed_special=known if any(s in t for s in self.special) else NONE, disallowed_special=()).astype("<u4").tobytes() for k, t in enumerate(texts)]

    def _by_chunks(self, texts: list[str]) -> list[bytes]:
        chunks = [self._chunks(t) for t in texts]
        distinct = set().union(*chunks)
        new = distinct.difference(self.cache)
        size = sum(map(len, new))
        if self.held + size > CACHED // 2:
            self.old, self.cache, self.held, new = self.cache, {}, 0, distinct
            size = sum(map(len, new))
        self.held += size
        if self.old:
            again = new.intersection(self.old)
            self.cache.update(zip(again, map(self.old.__getitem__, again)))
            new = new.difference(again)
        self.cache.update(self._coded(list(new)))
        out = [b"".join(map(self.cache.__getitem__, c)) for c in chunks]
        for c in new:
            if len(c) > LONGEST:
                del self.cache[c]
                self.held -= len(c)
        return out


@lru_cache(maxsize=1)
def encoder(path: str, drops_space: bool) -> LibraryEncoder:
    """One encoder a worker."""
    return LibraryEncoder(path, drops_space)
