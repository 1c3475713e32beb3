"""Binary records to Arrow columns and back, a stretch of records at a time: a column is cut out of, or put into, the bytes of all its records at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from readloom.functions.cigar import OPS
from readloom.functions.sequences import CODES
from readloom.sources.bgzf import FormatError

#: The fixed part of a record, as laid out there.
HEAD = np.dtype([("ref_id", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_ops", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("mate_ref_id", "<i4"), ("mate_pos", "<i4"), ("tlen", "<i4")])
PLACE = ("_voff_begin", "_voff_end", "_src_id", "_src_ord")
#: Columns that lie in the fixed part.
FAST = {"flag", "ref_id", "rname", "pos", "mapq", "mate_ref_id", "mate_rname", "mate_pos", "tlen", *PLACE}
#: Number type of each integer type letter, and of float arrays.
NUMBERS = {"c": "i1", "C": "u1", "s": "<i2", "S": "<u2", "i": "<i4", "I": "<u4", "f": "<f4"}
_WIDTH = np.zeros(256, np.int64)
for _k, _v in NUMBERS.items():
    _WIDTH[ord(_k)] = np.dtype(_v).itemsize
_WIDTH[ord("A")] = 1
#: Both bases of every byte.
_BASES = np.array([[ord(a), ord(b)] for a in CODES for b in CODES], np.uint8)
_OPS = pa.array(list(OPS))


def ragged(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all stretches one after the other, the offset of each among them and the end)."""
    offsets = np.r_[0, np.cumsum(lengths)]
    return buf[np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])], offsets


def _valid(mask: np.ndarray | None) -> pa.Buffer | None:
    return None if mask is None else pa.py_buffer(np.packbits(mask, bitorder="little").tobytes())


def strings(data: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """Text column of bytes; those that are not UTF-8 have their bad bytes replaced."""
    n = len(offsets) - 1
    out = pa.StringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()), _valid(valid))
    if data.size and data.max() > 127:
        raw = data.tobytes()
        return pa.array([raw[a:b].decode("utf-8", "replace") if valid is None or valid[i] else None for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))], pa.string())
    return out


def letters(codes: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """Text column of single bytes."""
    return strings(codes.astype(np.uint8), np.arange(len(codes) + 1), valid)


def lists(values: pa.Array, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    mask = None if valid is None else pa.array(~valid)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=mask)


def _numbers(buf: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    t = np.dtype(kind)
    return buf[at[:, None] + np.arange(t.itemsize)].view(t)[:, 0] if len(at) else np.empty(0, t)


def _tags(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(record, place, type, place of the value, size of the value) of every tag in order. The records are walked side by side, a tag of each at a time."""
    nul = np.flatnonzero(buf == 0)
    pos, active, found = begin.copy(), np.flatnonzero(begin < end), []
    while len(active):
        p, stop = pos[active], end[active]
        if (p + 3 > stop).any():
            raise FormatError("truncated tag")
        kind, v = buf[p + 2], p + 3
        size = _WIDTH[kind]
        text, array = (kind == ord("Z")) | (kind == ord("H")), kind == ord("B")
        if text.any():
            at = np.searchsorted(nul, v[text])
            if at.max() >= len(nul):
                raise FormatError("bad tag: text without end")
            size[text] = nul[at] - v[text] + 1
        if array.any():
            if (v[array] + 5 > stop[array]).any():
                raise FormatError("truncated tag")
            width, count = _WIDTH[buf[v[array]]], _numbers(buf, v[array] + 1, "<i4").astype(np.int64)
            if (count < 0).any() or not width.all():
                raise FormatError("bad tag: array")
            size[array] = 5 + width * count
        if not size.all():
            raise FormatError(f"unknown tag type {chr(kind[size == 0][0])!r}")
        if (v + size > stop).any():
            raise FormatError("truncated tag")
        found.append((active, p, kind, v, size))
        pos[active] = v + size
        active = active[v + size < stop]
    if not found:
        e = np.empty(0, np.int64)
        return e, e, e.astype(np.uint8), e, e
    cols = [np.concatenate(c) for c in zip(*found, strict=True)]
    order = np.argsort(cols[0], kind="stable")
    return tuple(c[order] for c in cols)


def _arrays(buf: np.ndarray, v: np.ndarray, sub: np.ndarray, count: np.ndarray, kinds: str, out: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of the array tags of the given subtypes; all others are empty."""
    mine = np.isin(sub, [ord(k) for k in kinds])
    offsets = np.r_[0, np.cumsum(np.where(mine, count, 0))]
    values = np.empty(offsets[-1], out)
    for k in kinds:
        el = np.flatnonzero(sub == ord(k))
        if len(el):
            t = np.dtype(NUMBERS[k])
            raw, at = ragged(buf, v[el] + 5, count[el] * t.itemsize)
            values[np.repeat(offsets[el] - at[:-1] // t.itemsize, count[el]) + np.arange(at[-1] // t.itemsize)] = raw.view(t)
    return values, offsets


def _aux(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    record, p, kind, v, size = _tags(buf, begin, end)
    n = len(p)
    is_ = lambda k: kind == ord(k)
    text = is_("Z") | is_("A")
    whole = np.zeros(n, np.int64)
    number = np.zeros(n, bool)
    for k in "cCsSiI":
        at = np.flatnonzero(is_(k))
        whole[at] = _numbers(buf, v[at], NUMBERS[k])
        number[at] = True
    real = np.zeros(n, np.float32)
    real[is_("f")] = _numbers(buf, v[is_("f")], "<f4")
    array = is_("B")
    sub = np.where(array, buf[np.where(array, v, 0)], 0).astype(np.uint8) if n else np.empty(0, np.uint8)
    count = np.zeros(n, np.int64)
    count[array] = _numbers(buf, v[array] + 1, "<i4")
    ints, int_at = _arrays(buf, v, sub, count, "cCsSiI", "i8")
    floats, float_at = _arrays(buf, v, sub, count, "f", "f4")
    hexes: list = [None] * n
    for i in np.flatnonzero(is_("H")).tolist():
        try:
            hexes[i] = bytes.fromhex(buf[v[i] : v[i] + size[i] - 1].tobytes().decode("ascii"))
        except ValueError as e:
            raise FormatError(f"bad tag: {e}") from e
    two, _ = ragged(buf, p, np.full(n, 2))
    fields = {
        "tag": strings(two, np.arange(n + 1) * 2), "type": letters(kind), "subtype": letters(sub, array), "sval": strings(*ragged(buf, v, np.where(text, size - is_("Z"), 0)), text),
        "ival": pa.array(whole, mask=~number), "fval": pa.array(real, mask=~is_("f")), "iarr": lists(pa.array(ints), int_at, array & (sub != ord("f"))), "farr": lists(pa.array(floats), float_at, array & (sub == ord("f"))),
        "bval": pa.array(hexes, pa.binary()),
    }
    return lists(pa.StructArray.from_arrays(list(fields.values()), list(fields)), np.r_[0, np.cumsum(np.bincount(record, minlength=len(begin)))])


def decode(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, begin: np.ndarray, after: np.ndarray, src: int, names: list[str], omit: str, schema: pa.Schema) -> pa.RecordBatch:
    """The columns of the schema of the records whose bodies lie at starts in buf; begin and after are their virtual offsets. omit: none, aux, or variable
    (sequence, qualities and tags left out, i.e. null)."""
    n = len(starts)
    head = buf[starts[:, None] + np.arange(HEAD.itemsize)].view(HEAD)[:, 0] if n else np.empty(0, HEAD)
    for c in ("ref_id", "mate_ref_id"):
        if n and not (-1 <= head[c].min() and head[c].max() < len(names)):
            raise FormatError("reference out of range")
    known = pa.array(names, pa.string())
    name, ops, bases = (head[c].astype(np.int64) for c in ("l_name", "n_ops", "l_seq"))
    half = (bases + 1) >> 1
    at_ops = starts + 32 + name
    at_seq = at_ops + 4 * ops
    at_aux = at_seq + half + bases
    if n and ((name < 1).any() or (bases < 0).any() or (at_aux > starts + sizes).any()) and not {f.name for f in schema} <= FAST:
        raise FormatError("truncated record")
    out = []
    for f in schema:
        c = f.name
        if c in ("rname", "mate_rname"):
            ids = head["ref_id" if c == "rname" else "mate_ref_id"]
            col = known.take(pa.array(ids, mask=ids < 0))
        elif c in ("ref_id", "mate_ref_id"):
            col = pa.array(head[c], mask=head[c] < 0)
        elif c == "_src_id":
            col = pa.array(np.full(n, src))
        elif c in PLACE:
            col = pa.array(after if c == "_voff_end" else begin)
        elif c in FAST:
            col = pa.array(head[c])
        elif c == "qname":
            col = strings(*ragged(buf, starts + 32, name - 1))
        elif c == "cigar":
            raw, at = ragged(buf, at_ops, 4 * ops)
            packed = raw.view("<u4")
            if packed.size and (packed & 15).max() >= len(OPS):
                raise FormatError("unknown operation")
            col = lists(pa.StructArray.from_arrays([pa.array((packed >> 4).astype(np.int64)), _OPS.take(pa.array((packed & 15).astype(np.int8)))], ["len", "op"]), at // 4)
        elif c == "seq" and omit != "variable":
            raw, at = ragged(buf, at_seq, half)
            both, keep = _BASES[raw].ravel(), np.ones(2 * len(raw), bool)
            keep[2 * at[1:][bases % 2 == 1] - 1] = False
            col = strings(both[keep], np.r_[0, np.cumsum(bases)], bases > 0)
        elif c == "qual" and omit != "variable":
            raw, at = ragged(buf, at_seq + half, bases)
            none = np.r_[0, np.cumsum(raw == 255)]
            col = lists(pa.array(raw.astype(np.int16)), at, none[at[1:]] - none[at[:-1]] < bases)
        elif c == "aux" and omit == "none":
            col = _aux(buf, at_aux, starts + sizes)
        else:
            col = pa.nulls(n, f.type)
        out.append(col.cast(f.type))
    return pa.RecordBatch.from_arrays(out, schema=schema)


_CODE = np.full(256, 15, np.uint8)
for _i, _c in enumerate(CODES):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i
#: Reference positions that an operation moves by.
_MOVES = np.array([{"M": 1, "D": 1, "N": 1, "=": 1, "X": 1, "B": -1}.get(c, 0) for c in OPS])


_LISTS = {
    "cigar": pa.list_(pa.struct([("len", pa.int64()), ("op", pa.string())])), "qual": pa.list_(pa.int16()),
    "aux": pa.list_(pa.struct([*((k, pa.string()) for k in ("tag", "type", "subtype", "sval")), ("ival", pa.int64()), ("fval", pa.float32()), ("iarr", pa.list_(pa.int64())), ("farr", pa.list_(pa.float32())), ("bval", pa.binary())])),
}


def _put(out: np.ndarray, at: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> None:
    """Stretches of data, one after the other, to the places at."""
    offsets = np.cumsum(lengths) - lengths
    out[np.repeat(at - offsets, lengths) + np.arange(len(data))] = data


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, length of each); a null has none."""
    col = (col if pa.types.is_string(col.type) else col.cast(pa.string())).fill_null("")
    at = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, 4 * col.offset).astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8)
    return data, np.diff(at)


def _first(col: pa.Array) -> np.ndarray:
    """First byte of each text, 0 of none."""
    data, n = _bytes(col)
    out = np.zeros(len(n), np.uint8)
    out[n > 0] = data[(np.cumsum(n) - n)[n > 0]]
    return out


def _list(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(values of all lists, length of each); a null has none."""
    return col.flatten(), pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _whole(col: pa.Array, default: int = 0) -> np.ndarray:
    return col.cast(pa.int64()).fill_null(default).to_numpy(zero_copy_only=False)


def _little(values: np.ndarray, kind: str) -> np.ndarray:
    """Bytes of numbers of a type; raises for those that it does not hold."""
    t = np.dtype(kind)
    out = values.astype(t)
    if t.kind != "f" and (out.astype(np.int64) != values).any():
        raise ValueError("number out of the range of its type")
    return out.view(np.uint8) if len(out) else np.empty(0, np.uint8)


def bins_of(beg: np.ndarray, end: np.ndarray) -> np.ndarray:
    last = end - 1
    levels = [(14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)]
    return np.select([beg >> s == last >> s for s, _ in levels], [o + (beg >> s) for s, o in levels], 0)


def _encode_aux(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the tags of all records, their length by record)."""
    elements, count = _list(col)
    n = len(elements)
    part = {f.name: c for f, c in zip(elements.type, elements.flatten(), strict=True)}
    tag, tag_len = _bytes(part["tag"])
    if (tag_len != 2).any():
        raise ValueError("a tag has two letters")
    kind, sub = _first(part["type"]), _first(part["subtype"])
    text, text_len = _bytes(part["sval"])
    hexes = np.flatnonzero(kind == ord("H"))
    raw = {int(i): (part["bval"][int(i)].as_py() or b"").hex().upper().encode() for i in hexes}
    arrays = {}
    for name in ("iarr", "farr"):
        arrays[name] = _list(part[name])
    size = 3 + _WIDTH[kind]
    z, a, b = kind == ord("Z"), kind == ord("A"), kind == ord("B")
    size[z] += text_len[z] + 1
    size[hexes] += np.array([len(raw[int(i)]) + 1 for i in hexes], np.int64)
    in_array = np.where(sub == ord("f"), arrays["farr"][1], arrays["iarr"][1])
    size[b] += 5 + _WIDTH[sub[b]] * in_array[b]
    known = z | b | (kind == ord("H")) | (_WIDTH[kind] > 0)
    if not known.all() or not _WIDTH[sub[b]].all() or (a & (text_len < 1)).any():
        raise ValueError("tag of an unknown type or without value")
    end = np.cumsum(size)
    at = end - size
    out = np.zeros(int(end[-1]) if n else 0, np.uint8)
    _put(out, at, tag, tag_len)
    out[at + 2] = kind
    v = at + 3
    starts = np.cumsum(text_len) - text_len
    out[v[a]] = text[starts[a]]
    _put(out, v[z], ragged(text, starts[z], text_len[z])[0], text_len[z])
    numbers = _whole(part["ival"])
    if part["ival"].null_count and np.isin(kind, [ord(k) for k in "cCsSiI"])[~part["ival"].is_valid().to_numpy(zero_copy_only=False)].any():
        raise ValueError("integer tag without value")
    for k in "cCsSiI":
        el = np.flatnonzero(kind == ord(k))
        width = np.dtype(NUMBERS[k]).itemsize
        _put(out, v[el], _little(numbers[el], NUMBERS[k]), np.full(len(el), width))
    el = np.flatnonzero(kind == ord("f"))
    _put(out, v[el], _little(part["fval"].fill_null(0.0).to_numpy(zero_copy_only=False)[el], "<f4"), np.full(len(el), 4))
    for i in hexes.tolist():
        out[v[i] : v[i] + len(raw[i])] = np.frombuffer(raw[i], np.uint8)
    out[v[b]] = sub[b]
    _put(out, v[b] + 1, _little(in_array[b], "<i4"), np.full(int(b.sum()), 4))
    for name, kinds in (("iarr", "cCsSiI"), ("farr", "f")):
        values, lengths = arrays[name]
        values = _whole(values) if name == "iarr" else values.fill_null(0.0).to_numpy(zero_copy_only=False)
        first = np.cumsum(lengths) - lengths
        for k in kinds:
            el = np.flatnonzero(b & (sub == ord(k)))
            if len(el):
                _put(out, v[el] + 5, _little(ragged(values, first[el], lengths[el])[0], NUMBERS[k]), lengths[el] * np.dtype(NUMBERS[k]).itemsize)
    before = np.r_[0, end][np.r_[0, np.cumsum(count)]]
    return out, np.diff(before)


def encode(batch: pa.RecordBatch) -> tuple[bytes, list[int]]:
    """(records with their size prefixes, the place where each ends); the bins are worked out again."""
    n = batch.num_rows
    col = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
    col |= {k: pa.nulls(n, t) for k, t in _LISTS.items() if col[k].null_count == n}  # whatever type a column of nulls has
    name, l_name = _bytes(col["qname"])
    if ((l_name < 1) | (l_name > 254)).any():
        raise ValueError("name length out of range")
    if (name == 0).any():
        raise ValueError("name with NUL")
    ops, n_ops = _list(col["cigar"])
    if (n_ops > 0xFFFF).any():
        raise ValueError("too many operations")
    parts = {f.name: c for f, c in zip(ops.type, ops.flatten(), strict=True)}
    length, op = _whole(parts["len"]), pc.index_in(parts["op"], value_set=_OPS)
    if op.null_count or ((length < 0) | (length >= 1 << 28)).any():
        raise ValueError("operation unknown or too long")
    op = op.to_numpy(zero_copy_only=False).astype(np.int64)
    seq, l_seq = _bytes(col["seq"])
    if seq.size and seq.max() > 127:
        raise ValueError("sequence with letters beyond ASCII")
    qual, l_qual = _list(col["qual"])
    if ((l_qual > 0) & (l_qual != l_seq)).any():
        raise ValueError("sequence/quality length mismatch")
    aux, l_aux = _encode_aux(col["aux"])
    half = (l_seq + 1) >> 1
    pos, flag = _whole(col["pos"], -1), _whole(col["flag"])
    moved = np.r_[0, np.cumsum(length * _MOVES[op])]
    first = np.cumsum(n_ops) - n_ops
    some = n_ops > 0
    top = np.zeros(n, np.int64)
    if some.any():
        top[some] = np.maximum(0, np.maximum.reduceat(moved[1:], first[some]) - moved[first[some]])
    end = np.where((flag & 4 != 0) | ~some, pos + 1, pos + top)
    sizes = 32 + l_name + 1 + 4 * n_ops + half + l_seq + l_aux
    ends = np.cumsum(sizes + 4)
    at = ends - sizes - 4
    head = np.empty(n, np.dtype([("size", "<i4"), *((k, HEAD[k]) for k in HEAD.names)]))
    head["size"] = sizes
    for k, v in (("ref_id", _whole(col["ref_id"], -1)), ("pos", pos), ("l_name", l_name + 1), ("mapq", _whole(col["mapq"])), ("bin", np.where(flag & 12 == 12, 4680, bins_of(pos, end) & 0xFFFF)), ("n_ops", n_ops),
                 ("flag", flag), ("l_seq", l_seq), ("mate_ref_id", _whole(col["mate_ref_id"], -1)), ("mate_pos", _whole(col["mate_pos"], -1)), ("tlen", _whole(col["tlen"]))):
        head[k] = v
        if (head[k].astype(np.int64) != v).any():
            raise ValueError(f"{k} out of range")
    out = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    _put(out, at, head.view(np.uint8), np.full(n, 36))
    p = at + 36
    _put(out, p, name, l_name)
    p = p + l_name + 1
    _put(out, p, (length << 4 | op).astype("<u4").view(np.uint8), 4 * n_ops)
    p = p + 4 * n_ops
    codes = np.zeros(2 * int(half.sum()), np.uint8)
    _put(codes, 2 * (np.cumsum(half) - half), _CODE[seq], l_seq)
    _put(out, p, codes[0::2] << 4 | codes[1::2], half)
    p = p + half
    given = l_qual > 0
    values = _whole(qual)
    _put(out, p[given], _little(values, "u1"), l_seq[given])
    _put(out, p[~given], np.full(int(l_seq[~given].sum()), 255, np.uint8), l_seq[~given])
    _put(out, p + l_seq, aux, l_aux)
    return out.tobytes(), ends.tolist()
