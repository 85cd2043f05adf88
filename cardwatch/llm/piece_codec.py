"""SentencePiece encoding and decoding by an Aho-Corasick automaton and one Viterbi pass.

The automaton over all pieces reads a text once. At every position its output links name
the pieces that end there, each of which may improve the best score up to that position.
A character that is no piece itself may become its bytes, at a score below every piece.
Of equal scores the longer last piece wins.

No piece holds a space behind another character (checked when the vocabulary is read), so
a text falls apart before every run of spaces, and at line ends, without a change of the
result. The parts of a batch are encoded together, each distinct part once, position by
position over arrays. A very long part (a text without spaces) is cut into windows that run
together, too: each begins some way before its own stretch, and counts only if its scores
there differ from those of the window before by one constant, over as many positions as the
longest piece has bytes. From there on both would choose alike, so the result is that of one
pass; a window that fails begins further back. Scores are multiples of 2 ** -20, so sums are exact.

The automaton is built once, on the driver, and written to the shared folder. Workers map
the file, so all workers of a machine share its pages and none holds a copy.

Encoding puts one space in front (as the vocabulary expects) and keeps every other
character: decoding gives back the exact text. Spaces are the vocabulary's own sign; that
sign itself, in a text, is written as bytes.

Defined cases: a null text has null ids and stays null when decoded; an empty text has no
ids. Repeated rows give repeated rows; ids that the vocabulary doesn't have fail to decode.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cardwatch.llm.base import lean
from cardwatch.llm.shared_arrays import SharedArrays, share

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MOST_PIECES = 1_000_000
BATCH_CHARS = 400_000
CELLS = 250_000
# Bytes of a part that is cut into windows, of a window's own stretch, and of its way before that.
LONG = 4096
STRETCH = 512
LEAD = 128
_GRID = 2.0**20

_SPACE = "▁"
_PART = re.compile(rb"\n| +[^ \n]*|[^ \n]+")


def read_vocabulary(path: str = VOCABULARY) -> dict:
    """Pieces as bytes (spaces as spaces) by id, their scores, and the ids of the 256 bytes."""
    import sentencepiece  # the driver alone reads the file

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    if size > MOST_PIECES:
        raise ValueError(f"{size} pieces; the automaton is made for {MOST_PIECES} at most")
    pieces, scores, byte_ids, usable = [], [], {}, []
    for k in range(size):
        name = model.id_to_piece(k)
        if model.is_byte(k):
            byte_ids[int(name[3:5], 16)] = k
            pieces.append(bytes([int(name[3:5], 16)]))
        elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
            pieces.append(b"")
        else:
            if _SPACE in name.lstrip(_SPACE) or "\n" in name or " " in name:
                raise ValueError(f"piece {k} crosses a word boundary")
            pieces.append(name.replace(_SPACE, " ").encode())
            usable.append(k)
        scores.append(round(model.get_score(k) * _GRID) / _GRID)
    if len(byte_ids) != 256:
        raise ValueError("the vocabulary has no piece for some bytes")
    least = min((scores[k] for k in usable if scores[k] > -1e8), default=0.0)
    return {"pieces": pieces, "scores": scores, "bytes": [byte_ids[b] for b in range(256)], "usable": usable, "fallback": least - 10.0}


def build_automaton(vocabulary: dict) -> dict:
    """Transitions of every state on every byte, the piece at a state, and output links."""
    pieces = vocabulary["pieces"]
    children: list[dict[int, int]] = [{}]
    piece_at = [-1]
    for k in vocabulary["usable"]:
        node = 0
        for byte in pieces[k]:
            if byte not in children[node]:
                children[node][byte] = len(children)
                children.append({})
                piece_at.append(-1)
            node = children[node][byte]
        if piece_at[node] < 0 or vocabulary["scores"][k] > vocabulary["scores"][piece_at[node]]:
            piece_at[node] = k
    n = len(children)
    step = np.zeros((n, 256), np.int32)
    fail, link = np.zeros(n, np.int32), np.zeros(n, np.int32)
    order = [0]
    for node in order:
        if node:
            step[node] = step[fail[node]]
            link[node] = fail[node] if piece_at[fail[node]] >= 0 else link[fail[node]]
        for byte, child in children[node].items():
            fail[child] = step[node][byte] if node else 0
            step[node][byte] = child
            order.append(child)
    piece_at = np.array(piece_at, np.int32)
    return {
        "step": step.reshape(-1).astype(np.uint16 if n <= 1 << 16 else np.int32),
        # The first state along the failure chain, itself included, where a piece ends; 0 if none.
        "output": np.where(piece_at >= 0, np.arange(n), link).astype(np.int32),
        "link": link,
        "piece_at": piece_at,
        "length": np.array([len(p) for p in pieces], np.int32),
        "score": np.array(vocabulary["scores"], np.float64),
        "bytes": np.array(vocabulary["bytes"], np.int32),
        "fallback": np.array([vocabulary["fallback"]]),
        "longest": np.array([max((len(pieces[k]) for k in vocabulary["usable"]), default=1)]),
    }


def _tables(parts: list[bytes], auto: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each part its length, and for each of its positions the best score up to there, the last token and its bytes."""
    size = np.array([len(p) for p in parts], np.int64)
    m, width = len(parts), int(size.max())
    text = np.zeros((m, width), np.uint8)
    inside = np.arange(width) < size[:, None]
    text[inside] = np.frombuffer(b"".join(parts), np.uint8)
    # The character that ends with byte i starts at byte first[i]; it ends there if the next byte starts another.
    starts = (text & 0xC0) != 0x80
    first = np.maximum.accumulate(np.where(starts, np.arange(width), 0), axis=1)
    ends = np.ones((m, width), bool)
    ends[:, :-1] = starts[:, 1:]
    ends[np.arange(m), size - 1] = True
    best = np.full((m, width + 1), -np.inf)
    best[:, 0] = 0.0
    token = np.zeros((m, width + 1), np.int32)
    token[:, 1:] = auto["bytes"][text]
    back = np.ones((m, width + 1), np.int32)
    state = np.zeros(m, np.int64)
    for i in range(width):
        state = auto["step"][state * 256 + text[:, i]].astype(np.int64)
        alone = ~ends[:, i]
        at = auto["output"][state]
        rows = np.flatnonzero((at > 0) & inside[:, i])
        at = at[rows]
        while len(rows):
            piece = auto["piece_at"][at]
            length = auto["length"][piece]
            score = best[rows, i + 1 - length] + auto["score"][piece]
            alone[rows[i + 1 - length == first[rows, i]]] = True
            better = score > best[rows, i + 1]
            r = rows[better]
            best[r, i + 1], token[r, i + 1], back[r, i + 1] = score[better], piece[better], length[better]
            at = auto["link"][at]
            rows, at = rows[at > 0], at[at > 0]
        rows = np.flatnonzero(~alone & inside[:, i])
        if len(rows):
            score = best[rows, first[rows, i]] + auto["fallback"][0]
            better = score > best[rows, i + 1]
            r = rows[better]
            best[r, i + 1], token[r, i + 1], back[r, i + 1] = score[better], auto["bytes"][text[r, i]], 1
    return size, best, token, back


def _viterbi(parts: list[bytes], auto: dict) -> tuple[np.ndarray, np.ndarray]:
    """Token counts of the parts and their tokens in one row. Parts have similar lengths."""
    size, _, token, back = _tables(parts, auto)
    m = len(parts)
    # Back from the ends, all parts at once.
    count, steps = np.zeros(m, np.int64), []
    rows, place = np.arange(m), size.copy()
    while len(rows):
        steps.append((rows, token[rows, place]))
        count[rows] += 1
        place = place - back[rows, place]
        rows, place = rows[place > 0], place[place > 0]
    stop = np.cumsum(count)
    out = np.empty(int(stop[-1]), np.int32)
    for k, (rows, found) in enumerate(steps):
        out[stop[rows] - 1 - k] = found
    return count, out


def _long_viterbi(part: bytes, auto: dict) -> np.ndarray:
    """The tokens of one long part, from windows that run together."""
    n, longest = len(part), int(auto["longest"][0])
    starts = np.flatnonzero((np.frombuffer(part, np.uint8) & 0xC0) != 0x80)

    def start_before(place: int) -> int:
        """Where the last character begins that begins there or before."""
        return int(starts[max(0, np.searchsorted(starts, place, side="right") - 1)])

    cuts = sorted({0, *(start_before(c) for c in range(STRETCH, n, STRETCH))}) + [n]
    token, back = np.zeros(n + 1, np.int32), np.ones(n + 1, np.int32)
    before: np.ndarray | None = None  # the true scores at the last positions up to the cut, but for a constant

    def run(wanted: list[tuple[int, int, int]]) -> list[tuple]:
        _, best, tokens, backs = _tables([part[s:e] for s, _, e in wanted], auto)
        return list(zip(best, tokens, backs))

    def fits(best: np.ndarray, first: int, cut: int) -> bool:
        own = best[max(0, cut - longest - first) : cut - first + 1]
        if before is None or len(own) < len(before):
            return before is None
        known = before[len(before) - len(own) :]
        finite = np.isfinite(known)
        if not np.array_equal(finite, np.isfinite(own)):
            return False
        apart = known[finite] - own[finite]
        return bool((apart == apart[0]).all())

    windows = [(start_before(max(0, c - LEAD)), c, e) for c, e in zip(cuts, cuts[1:])]
    together = max(1, CELLS // (STRETCH + LEAD))
    for k in range(0, len(windows), together):
        group = windows[k : k + together]
        for (first, cut, end), found in zip(group, run(group)):
            lead = LEAD
            while first and not fits(found[0], first, cut):
                lead *= 4
                first = start_before(max(0, cut - lead))
                found = run([(first, cut, end)])[0]
            best, tokens, backs = found
            token[cut + 1 : end + 1] = tokens[cut - first + 1 : end - first + 1]
            back[cut + 1 : end + 1] = backs[cut - first + 1 : end - first + 1]
            before = best[max(0, end - first - longest) : end - first + 1].copy()
    out, place, tokens, backs = [], n, token.tolist(), back.tolist()
    while place > 0:
        out.append(tokens[place])
        place -= backs[place]
    return np.array(out[::-1], np.int32)


def encode_parts(parts: list[bytes], auto: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and count of each part's tokens in a common row of tokens."""
    order = sorted((k for k in range(len(parts)) if len(parts[k]) < LONG), key=lambda k: len(parts[k]))
    start, count, rows, k, at = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), [], 0, 0
    for long in (k for k in range(len(parts)) if len(parts[k]) >= LONG):
        tokens = _long_viterbi(parts[long], auto)
        start[long], count[long] = at, len(tokens)
        rows.append(tokens)
        at += len(tokens)
    while k < len(order):
        short, stop = len(parts[order[k]]), k
        while stop < len(order) and len(parts[order[stop]]) <= short * 1.25 + 1 and (stop - k) * len(parts[order[stop]]) <= CELLS:
            stop += 1
        chosen = order[k:stop]
        n, tokens = _viterbi([parts[c] for c in chosen], auto)
        count[chosen] = n
        start[chosen] = at + np.cumsum(n) - n
        rows.append(tokens)
        at += len(tokens)
        k = stop
    return start, count, np.concatenate(rows) if rows else np.empty(0, np.int32)


def encode_texts(texts: list[str | None], auto: dict) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's ids end, and the ids of all texts in a row."""
    numbers: dict[bytes, int] = {}
    used, ends = [], []
    for text in texts:
        if text:
            used += [numbers.setdefault(p, len(numbers)) for p in _PART.findall(b" " + text.encode())]
        ends.append(len(used))
    start, count, tokens = encode_parts(list(numbers), auto)
    used = np.array(used, np.int64)
    times = count[used]
    after = np.cumsum(times)
    ids = tokens[np.repeat(start[used] - (after - times), times) + np.arange(int(after[-1]) if len(after) else 0)]
    return np.concatenate([[0], after])[ends], ids


def decode_ids(ids: list[int] | np.ndarray | None, vocabulary: dict) -> str | None:
    if ids is None:
        return None
    pieces = vocabulary["pieces"]
    return b"".join([pieces[k] for k in ids])[1:].decode()


def _chunks(batches, column: int) -> Iterator[tuple[list, list]]:
    """Batches and their texts, gathered to a fixed amount of text."""
    kept, texts, size = [], [], 0
    for batch in batches:
        kept.append(batch)
        texts += batch.column(column).to_pylist()
        size += sum(len(t) for t in texts[len(texts) - batch.num_rows :] if t)
        if size >= BATCH_CHARS:
            yield kept, texts
            kept, texts, size = [], [], 0
    if kept:
        yield kept, texts


def _encode(automaton: SharedArrays, column: int):
    def run(batches):
        arrays = automaton.load()
        for kept, texts in _chunks(batches, column):
            stop, ids = encode_texts(texts, arrays)
            bounds, at = np.concatenate([[0], stop]), 0
            for batch in kept:
                own = bounds[at : at + batch.num_rows + 1]
                none = [t is None for t in texts[at : at + batch.num_rows]] + [False]
                lists = pa.ListArray.from_arrays(
                    pa.array((own - own[0]).astype(np.int32), mask=np.array(none)), pa.array(ids[own[0] : own[-1]])
                )
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(np.diff(own), pa.int64()), lists], names=[*batch.schema.names, "n_tokens", "token_ids"]
                )

    return lean(run)


def _decode(vocabulary, column, name):
    def run(batches):
        for batch in batches:
            ids, pieces = batch.column(column), vocabulary.value
            texts = [decode_ids(x.values.to_numpy() if x.is_valid else None, pieces) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return lean(run)


def _without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that would clash with those to be added."""
    clash = {n.lower() for n in names}
    return df.select(*(df[c] for c in df.columns if c.lower() not in clash))


def encode(documents: DataFrame, vocabulary: dict) -> DataFrame:
    """The documents with n_tokens and token_ids of their texts (columns of these names are replaced)."""
    docs = _without(documents, "n_tokens", "token_ids")
    known = share(docs.sparkSession, build_automaton(vocabulary), "pieces")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(_encode(known, docs.columns.index("text")), schema)


def decode(encoded: DataFrame, vocabulary: dict, name: str = "decoded") -> DataFrame:
    """The rows with the text of their token_ids."""
    rows = _without(encoded, name)
    known = rows.sparkSession.sparkContext.broadcast({"pieces": vocabulary["pieces"]})
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])
    return rows.mapInArrow(_decode(known, rows.columns.index("token_ids"), name), schema)
