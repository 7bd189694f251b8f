"""Token counts by byte-pair merging, without token ids.

A text is cut as the byte-level tokenizer cuts it; each piece starts as one
symbol per byte, and the adjacent pair of lowest rank is merged again and again.
The count is the number of symbols at the start less the number of merges.
"""

import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import functions as F

#: Fixed value: how byte-level vocabularies cut a text before merging.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CACHE = 1_000_000


def byte_letters():
    """The letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 stands for itself, the others take the letters from 256 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(other)}}


class Merges:
    """Pair ranks of a vocabulary file, and counts of texts by them."""

    def __init__(self, path):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or not spec["pre_tokenizer"].get("use_regex"):
            raise ValueError("a byte-level BPE vocabulary is needed")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # Symbols are numbered only for comparison; a merge of numbers gives (rank, number of the result).
        number = {s: i for i, s in enumerate({x: None for p in pairs for x in (*p, p[0] + p[1])})}
        self.rank = {(number[a], number[b]): (r, number[a + b]) for r, (a, b) in reversed(list(enumerate(pairs)))}
        letters = byte_letters()
        self.start = [number.get(letters[b], -1 - b) for b in range(256)]
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.known = {}

    def piece(self, text):
        """Tokens of one piece: bytes less merges."""
        data = text.encode("utf-8", "surrogatepass")
        n = count = len(data)
        if n < 2:
            return n
        symbol = [self.start[b] for b in data]
        rank = self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            merge = rank.get((symbol[i], symbol[i + 1]))
            if merge is not None:
                heap.append((merge[0], i, symbol[i], symbol[i + 1], merge[1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            # An entry is stale once either of its symbols was merged away.
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue
            symbol[i], symbol[j] = made, None
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                merge = rank.get((made, symbol[k]))
                if merge is not None:
                    heapq.heappush(heap, (merge[0], i, made, symbol[k], merge[1]))
            h = before[i]
            if h >= 0:
                merge = rank.get((symbol[h], made))
                if merge is not None:
                    heapq.heappush(heap, (merge[0], h, symbol[h], made, merge[1]))
        return count

    def chunk(self, text):
        """Tokens of a stretch that starts and ends between pieces."""
        known = self.known
        count = known.get(text)
        if count is None:
            count = 0
            for piece in PIECES.findall(text):
                one = known.get(piece)
                if one is None:
                    one = self.piece(piece)
                    if len(known) < CACHE and len(piece) < 64:
                        known[piece] = one
                count += one
            if len(known) < CACHE and len(text) < 64:
                known[text] = count
        return count

    def plain(self, text):
        """Tokens of a text without special strings. A single blank between two
        other characters always starts a piece, so the text is cut there and the
        stretches, most of them known, are added up."""
        if not text:
            return 0
        parts = text.split(" ")
        if "" in parts or not text.isascii() and any(p[0].isspace() or p[-1].isspace() for p in parts):
            return self.chunk(text)
        get, total = self.known.get, self.chunk(parts[0])
        for part in parts[1:]:
            if part[0].isspace():
                return self.chunk(text)
            part = " " + part
            total += get(part) or self.chunk(part)
        return total

    def count(self, text):
        """Tokens of a text; a special string is one token, as the library has it by default."""
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


def count_tokens(docs, path, id_col="doc_id", text_col="text"):
    """(_id, _n_bytes, _n_tokens) of each row's whole text.

    ``path`` is a place where every worker finds the vocabulary file, or a function
    that gives it there. Null counts as empty: no bytes, no tokens. Repeated rows
    are counted each; other columns are not read; an empty table gives no rows.
    """
    def work(batches):
        counter = Merges(path() if callable(path) else path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = pa.array([counter.count(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), sizes], ["_id", "_n_bytes", "_n_tokens"])

    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.octet_length(text).cast("long").alias("_n_bytes"))
    return rows.mapInArrow(work, f"_id {rows.schema['_id'].dataType.simpleString()}, _n_bytes long, _n_tokens long")
