"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

Merging is replaced by a forward machine over the symbols of a pre-token. A token sequence is the BPE
encoding exactly when each token encodes to itself and each adjacent pair encodes to itself, so the last
token of the encoding of every prefix is unique: it is the token that ends there and is compatible with the last
token of what stands before it. `sufficient_lookahead` derives from the merge list how many symbols the front has to
run ahead of a token for it to be stable; stable tokens leave the machine, which so holds twice that many
symbols at most. Pre-tokens shorter than that window run through the same machine, which remembers what it found for their prefixes.

Decoding is a state machine too: ids go in one at a time, text comes out as soon as its bytes form
whole characters (or, for a vocabulary without a decoder, as token strings with single spaces between). A
document is read in slices that end at white space, a slice's tokens go through the decoder and into running
digests, and nothing but the text itself grows with its length. What the machines give for a pre-token is remembered, for a
bounded number of them; a remembered decoding is used where no character is unfinished.

Edge cases: null and empty texts give no tokens; a repeated row is encoded again; very long words pass
through the machine with bounded memory; a clashing extra column is dropped from what `encode_documents`
returns, which holds only the columns in its schema. A vocabulary without all byte symbols is refused.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from chartloom.llm import common as c

#: Bytes as the printable characters of byte-level vocabularies: a published, fixed mapping, built by its rule.
_KEEP = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHAR = {b: chr(b) for b in _KEEP} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_KEEP))}
CHAR_BYTE = {c: b for b, c in BYTE_CHAR.items()}
#: White space of the vocabulary's patterns: the Unicode property.
_WHITE = r"\t-\r \x85\xa0  -     　"
_SPACE = regex.compile(f"[{_WHITE}]")
#: Pre-tokens and prefixes remembered by a worker, and the longest of them.
CACHE, PREFIXES, LONGEST = 400_000, 20_000, 64
#: Characters of a text that are tokenised at a time, more only up to the next white space.
SLICE = 1 << 16


class Memory(dict):
    """A bounded memo of two generations: what is asked for stays, what isn't goes when both are full."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most // 2, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is not None:
            self.keep(key, value)
        return value

    def keep(self, key, value):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Vocabulary:
    """Merges, tokens and text rules of a `tokenizers` JSON file of kind BPE with an end-of-word suffix."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", []) if x["special"]}
        self.token_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"\s", _WHITE))
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.has_decoder = spec.get("decoder") is not None
        self.longest = max(len(self._symbols_of(t)) for t in self.vocab)
        self.pair_of = {a + b: (a, b) for a, b in reversed(self.ranks)}  # of several merges to one token the first counts
        self._right: dict[str, list] = {}
        self._left: dict[str, list] = {}
        self._whole: dict[str, bool] = {}
        self.together: dict[str, set[str]] = {}
        self.verdicts: dict[tuple[str, str], bool] = {}
        self.prefixes: dict = {}  # by symbol: the last token of a prefix, and what may follow
        self.n_prefixes = 0
        self.reach: dict[str, int] = {}  # the longest token that ends in two symbols, or is one
        for token in self.vocab:
            self.reach[token[-2:]] = max(self.reach.get(token[-2:], 1), len(token))
        if missing := [b for b in BYTE_CHAR.values() if b not in self.vocab or b + self.suffix not in self.vocab]:
            raise ValueError(f"no tokens for the symbols {missing[:5]}")
        self.lookahead = self.sufficient_lookahead()

    def _symbols_of(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """The plain definition: the lowest-ranked adjacent pair merges, leftmost first, until none is left."""
        symbols = list(symbols)
        while len(symbols) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def whole(self, token: str) -> bool:
        ok = self._whole.get(token)
        if ok is None:
            ok = self._whole[token] = self.merged(self._symbols_of(token)) == [token]
        return ok

    def _edge(self, token: str, side: int) -> list[tuple[str, int, int]]:
        """What stands at a token's right (side 1) or left (side 0) edge while it forms: (symbol, the rank
        that makes it, the rank that absorbs it), from the whole token down to a single symbol."""
        out, absorbed = [], 1 << 60
        while True:
            pair = self.pair_of.get(token)
            made = self.ranks[pair] if pair else -1
            out.append((token, made, absorbed))
            if pair is None:
                return out
            token, absorbed = pair[side], made

    def fits(self, a: str, b: str) -> bool:
        """Whether a and b stay apart: no merge joins an edge of a with an edge of b while both stand there.
        Of equal ranks the leftmost goes first: a's own merge before the joint one, the joint one before b's."""
        right = self._right.get(a) or self._right.setdefault(a, self._edge(a, 1))
        left = self._left.get(b) or self._left.setdefault(b, self._edge(b, 0))
        for x, made_x, gone_x in right:
            for y, made_y, gone_y in left:
                rank = self.ranks.get((x, y))
                if rank is not None and made_x < rank < gone_x and made_y < rank <= gone_y:
                    return False
        return True

    def successors(self, left: str) -> set[str]:
        """The tokens known to be whole and to stay apart from what is left of them ("" for nothing)."""
        known = self.together.get(left)
        if known is None:
            known = self.together[left] = set()
        return known

    def joins(self, left: str, token: str) -> bool:
        """Whether a token encodes to itself and stays apart from what is left of it."""
        key = (left, token)
        ok = self.verdicts.get(key)
        if ok is None:
            if len(self.verdicts) >= CACHE:
                self.verdicts.clear()
                for known in self.together.values():
                    known.clear()
            ok = self.verdicts[key] = self.whole(token) and (not left or self.fits(left, token))
        if ok:
            self.successors(left).add(token)
        return ok

    def sufficient_lookahead(self) -> int:
        """Symbols after which no later symbol changes a token.

        A later symbol reaches back only through merges that each pre-empt one of higher rank number to
        their left: (x, y) pre-empts (u, v) if v starts being x, or if it pre-empts the merge that makes v.
        The longest such chain, times the longest token, bounds the reach.
        """
        chain: dict[str, int] = {}
        by_left: dict[str, int] = {}
        for u, v in self.ranks:
            chain[u + v] = reach = 1 + max(chain.get(v, 0), by_left.get(v, 0))
            by_left[u] = max(by_left.get(u, 0), reach)
        return max(chain.values(), default=1) * self.longest


class Transducer:
    """Encodes one pre-token, pushed symbol by symbol; every token comes out once it is stable."""

    def __init__(self, vocabulary: Vocabulary, lookahead: int | None = None):
        self.v = vocabulary
        self.lookahead = vocabulary.lookahead if lookahead is None else lookahead
        self.text: list[str] = []  # symbols since the last stable boundary
        self.last: list[str] = [""]  # the token that ends before symbol i
        self.before = ""  # the stable token before them

    def _step(self, final: bool) -> None:
        v, j = self.v, len(self.text)
        joined = "".join(self.text[max(0, j - v.longest) :])
        tail = v.suffix if final else ""
        base = j - len(joined)
        for i in range(base, j):
            token = joined[i - base :] + tail
            if token in v.vocab and v.joins(self.last[i] if i else self.before, token):
                self.last.append(token)
                return
        raise AssertionError("every prefix has an encoding: the symbols are tokens")

    def _path(self, final: bool = False) -> list[str]:
        out: list[str] = []
        j = len(self.text)
        while j > 0:
            out.append(self.last[j])
            j -= len(self.last[j]) - (len(self.v.suffix) if final and len(out) == 1 else 0)
        return out[::-1]

    def push(self, symbol: str) -> list[str]:
        """Symbols but the last of a pre-token. Returns tokens that have become stable."""
        self.text.append(symbol)
        self._step(False)
        if len(self.text) < 2 * self.lookahead:
            return []
        done, end = [], 0
        for token in self._path():
            if end + len(token) > len(self.text) - self.lookahead:
                break
            done.append(token)
            end += len(token)
        if done:
            self.before, self.text, self.last = done[-1], self.text[end:], ["", *self.last[end + 1 :]]
        return done

    def finish(self, symbol: str) -> list[str]:
        """The last symbol of the pre-token. Returns the tokens left and is ready for the next pre-token."""
        self.text.append(symbol)
        self._step(True)
        out = self._path(final=True)
        self.text, self.last, self.before = [], [""], ""
        return out


def run_short(v: Vocabulary, text: str) -> list[str]:
    """The same machine over a pre-token within the window, where nothing leaves early."""
    n, vocab, reach, together = len(text), v.vocab, v.reach, v.together
    last, beside, node, j = [""], [v.successors("")], v.prefixes, 0
    for ch in text[:-1]:
        j += 1
        known = node.get(ch)
        if known is None:
            i = j - reach.get(text[j - 2 : j] if j > 1 else ch, 1)
            for i in range(i if i > 0 else 0, j):
                token = text[i:j]
                if token in beside[i] or token in vocab and v.joins(last[i], token):
                    break
            known = (token, {})
            if v.n_prefixes < PREFIXES:
                node[ch] = known
                v.n_prefixes += 1
        token, node = known
        last.append(token)
        beside.append(together.get(token) or v.successors(token))
    text += v.suffix
    for i in range(n - v.longest if n > v.longest else 0, n):
        token = text[i:]
        if token in beside[i] or token in vocab and v.joins(last[i], token):
            break
    last.append(token)
    out, j = [last[n]], n - len(last[n]) + len(v.suffix)
    while j:
        out.append(last[j])
        j -= len(last[j])
    return out[::-1]


class Decoder:
    """Ids in, text out, a token at a time; holds at most the bytes of one unfinished character."""

    def __init__(self, vocabulary: Vocabulary, as_bytes: bool | None = None):
        self.v, self.started, self.pending = vocabulary, False, b""
        self.as_bytes = vocabulary.has_decoder if as_bytes is None else as_bytes

    def push(self, token_id: int) -> str:
        token = self.v.token_of.get(token_id)
        if token is None:
            return ""
        if not self.as_bytes:  # no decoder in the file: token strings, a space between
            out = (" " if self.started else "") + token
            self.started = True
            return out
        gap = self.v.suffix and token.endswith(self.v.suffix)
        self.pending += bytes(CHAR_BYTE[c] for c in (token[: -len(self.v.suffix)] if gap else token)) + (b" " if gap else b"")
        n = len(self.pending)
        for back in range(1, min(3, n) + 1):  # an unfinished character at the end stays
            b = self.pending[-back]
            if b >= 0xC0:
                if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4):
                    n -= back
                break
            if b < 0x80:
                break
        out, self.pending = self.pending[:n].decode("utf-8", "replace"), self.pending[n:]
        return out

    def finish(self) -> str:
        out, self.pending, self.started = self.pending.decode("utf-8", "replace"), b"", False
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(map(self.push, ids)) + self.finish()


#: A pre-token's number of tokens, its ids in decimal, and what the decoder gives for them behind other tokens, or None
#: where an unfinished character would stay behind.
Piece = tuple[int, str, str | None]


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.machine = Transducer(vocabulary)
        self.decoder = Decoder(vocabulary)
        self.known = Memory(CACHE)

    def tokens(self, text: str) -> list[str]:
        """A pre-token's tokens."""
        symbols = text if text.isascii() and text.isprintable() else "".join([BYTE_CHAR[b] for b in text.encode("utf-8", "surrogatepass")])
        if len(symbols) < 2 * self.v.longest:
            return run_short(self.v, symbols)
        out: list[str] = []
        for s in symbols[:-1]:
            out += self.machine.push(s)
        return out + self.machine.finish(symbols[-1])

    def piece(self, text: str, ids: list[int] | None = None) -> Piece:
        vocab, decoder = self.v.vocab, self.decoder
        if ids is None:
            ids = [vocab[t] for t in self.tokens(text)]
        decoder.started = True
        decoded = "".join(map(decoder.push, ids))
        out = len(ids), " ".join(map(str, ids)), None if decoder.pending else decoded
        decoder.pending = b""
        if len(text) <= LONGEST:
            self.known.keep(text, out)
        return out

    def plain(self, text: str) -> list[Piece]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        known, piece = self.known, self.piece
        return [known[p] or piece(p) for p in self.v.pieces.findall(text.lower())]

    def pieces(self, text: str) -> Iterator[list[Piece]]:
        """The pre-tokens of a text, slice by slice."""
        special, at = self.v.split_special, 0
        while at < len(text):
            end = len(text)
            if end - at > SLICE and (space := _SPACE.search(text, at + SLICE)):
                end = space.start()
            part, at = text[at:end], end
            if special and special.search(part):
                yield [x for p in special.split(part) if p for x in ([self.known[p] or self.piece(p, [self.v.special[p]])] if p in self.v.special else self.plain(p))]
            else:
                yield self.plain(part)

    def document(self, text: str, ids: list[int] | None = None) -> tuple[int, str, str]:
        """(tokens, digest of the ids joined by spaces, digest of the decoded text); ids: gets the ids."""
        n, listed, decoded, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(self.v)
        for found in self.pieces(text):
            if not found:
                continue
            listed.update((" " * (n > 0) + " ".join([w[1] for w in found])).encode())
            if not n and not decoder.as_bytes:  # the first token of all has no space before it
                first = found[0][1].split()
                decoded.update("".join([decoder.push(int(i)) for i in first]).encode())
                rest = found[1:]
            else:
                rest = found
            texts = [w[2] for w in rest]
            if decoder.pending or None in texts:
                texts = [decoder.push(int(i)) for w in rest for i in w[1].split()]
            decoded.update("".join(texts).encode("utf-8", "surrogatepass"))
            n += sum([w[0] for w in found])
            if ids is not None:
                ids.extend(int(i) for w in found for i in w[1].split())
        decoded.update(decoder.finish().encode())
        return n, listed.hexdigest(), decoded.hexdigest()


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS_SCHEMA = SCHEMA + ", ids array<int>"


def encode_documents(docs: DataFrame, vocabulary: bytes, ids: bool = False) -> DataFrame:
    """Each row of docs (doc_id, text) encoded and decoded: token count, digests, and the ids if asked for."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary file: a fixed few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c.worker_of("bpe")
        encoder = Encoder(Vocabulary(shipped.value))
        for batch in batches:
            for part, _, _ in c.chunks(batch):
                lists = [[] for _ in range(part.num_rows)] if ids else [None] * part.num_rows
                got = [encoder.document(t.as_py() or "", own) for t, own in zip(part.column("text"), lists)]
                out = [part.column("doc_id").cast(pa.int64()), *(pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string())))]
                if ids:
                    out.append(pa.array(lists, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(out)])
        del encoder  # a worker that waits for another task holds no memo
        gc.collect()

    return docs.select("doc_id", "text").mapInArrow(c.lean(run), IDS_SCHEMA if ids else SCHEMA)


def vocabulary_bytes(path: str | None = None) -> bytes:
    """A vocabulary file, by default the public word-level BPE of the installed package."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        return f.read()
