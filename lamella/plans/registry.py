"""Registry of schemes and width combinations by name.

Keys read scheme/words/index, such as "delta/u32/u8/index4". Each entry validates an encoded column before it decodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from ..encoded import EncodedColumn
from ..operators import layout
from ..operators.schemes import bitmaps, delta, dictionary, dzb_fixed, dzb_variable, frame_of_reference, model, rle, rpe
from ..types import EncodingError


class UnknownScheme(KeyError):
    pass


@dataclass(frozen=True)
class SchemeSpec:
    key: str
    run: Callable
    parts: dict[str, tuple[str, ...]]
    params: tuple[str, ...] = ()
    widths: dict = field(default_factory=dict)

    def check(self, column: EncodedColumn) -> None:
        """Missing parts, columns or parameters, other widths than the entry's, and positions beyond its index are errors."""
        for name, columns in self.parts.items():
            column.part(name, *columns)
        for name in self.params:
            column.param(name)
        for name, want in self.widths.items():
            if name in ("word", "stored", "lengths", "positions", "model") and column.params.get(name, want) != want:
                raise EncodingError(f"{self.key}: {name} is {column.params[name]}")
        if column.length > 1 << 8 * self.widths["index"]:
            raise EncodingError(f"{self.key}: {column.length} positions")

    def decode(self, column: EncodedColumn, **more):
        self.check(column)
        return self.run(column, **more)


class Registry:
    def __init__(self):
        self._specs: dict[str, SchemeSpec] = {}

    def add(self, spec: SchemeSpec, ignore_repeats: bool = True) -> None:
        if spec.key in self._specs:
            if ignore_repeats:
                return
            raise EncodingError(f"{spec.key} is registered already")
        self._specs[spec.key] = spec

    def scheme(self, key: str, parts: dict, params: tuple = (), widths: dict | None = None, ignore_repeats: bool = True):
        """Decorator that registers a decode function of one's own."""

        def put(fn):
            self.add(SchemeSpec(key, fn, parts, params, {"index": 8} | (widths or {})), ignore_repeats)
            return fn

        return put

    def __getitem__(self, key: str) -> SchemeSpec:
        if key not in self._specs:
            raise UnknownScheme(f"no scheme {key!r}")
        return self._specs[key]

    def __contains__(self, key: str) -> bool:
        return key in self._specs

    def __iter__(self) -> Iterator[str]:
        return iter(self._specs)

    def __len__(self) -> int:
        return len(self._specs)


def _scatter(column: EncodedColumn, **_):
    return layout.scatter(column.part("target", "pos", "value"), column.part("patch", "pos", "value"))


def _compressed(column: EncodedColumn, **_):
    p = column.params
    return layout.compressed_indices_scatter(column.parts["target"], column.parts["data"], column.parts["runs"], column.parts["offset_bytes"], index_size=p.get("index_size", 4), chunk_bytes=p.get("chunk_bytes"), anchors=column.parts.get("anchors"), period=p.get("anchoring_period"))


def standard() -> Registry:
    """All width combinations, by the rules of which there are any."""
    out = Registry()

    def add(key, run, parts, params=(), **widths):
        out.add(SchemeSpec(f"{key}/index{widths['index']}", run, parts, params, widths), ignore_repeats=False)

    u = lambda n: f"u{8 * n}"
    sizes = (1, 2, 4, 8)
    for i in (4, 8):
        for wide in sizes:
            for narrow in (n for n in sizes if n < wide):
                add(f"delta/{u(wide)}/{u(narrow)}", delta.decode, {"compressed_input": ("pos", "delta"), "anchor_values": ("seg", "anchor")}, ("segment_length", "word"), word=u(wide), stored=u(narrow), index=i)
                add(f"dzb_fixed/{u(wide)}/{u(narrow)}", dzb_fixed.decode, {"compressed_input": ("pos", "v")}, ("word", "stored"), word=u(wide), stored=u(narrow), index=i)
            for narrow in (n for n in sizes if n <= wide):
                add(f"dictionary/{u(wide)}/{u(narrow)}", dictionary.decode, {"compressed_input": ("pos", "code"), "dictionary_entries": ("code", "value")}, word=u(wide), stored=u(narrow), index=i)
            for places in sizes:
                add(f"scatter/{u(wide)}/{u(places)}", _scatter, {"target": ("pos", "value"), "patch": ("pos", "value")}, index=i)
                add(f"compressed_indices_scatter/{u(wide)}/{u(places)}", _compressed, {"target": ("pos", "value"), "data": ("p", "value"), "runs": ("run", "length", "offset_bits", "baseline", "offsets_start"), "offset_bytes": ("chunk", "bytes")}, index=i)
    parts = {"compressed_data": ("bytes",), "packed_element_sizes": ("container", "word"), "position_anchors": ("seg", "byte_offset")}
    for wide in (2, 4, 8):
        for container, i in ((4, 4), (4, 8), (8, 4)):
            add(f"dzb_variable/{u(wide)}/container{container}", dzb_variable.decode, parts, ("segment_length", "word", "min_represented_element_size", "bits_per_element_size"), word=u(wide), index=i)
    parts = {"compressed_input": ("pos", "offset"), "segment_model_coefficients": ("seg",)}
    for name, wide, narrow, place, i in [
        *(("linear", w, n, 4, 4) for w, n in (("i16", "i8"), ("i32", "i8"), ("i32", "i16"))),
        ("linear", "i32", "i16", 4, 8), ("linear", "i32", "i16", 8, 8),
        *(("constant", w, n, 4, 4) for w, n in (("i16", "i8"), ("i32", "i8"), ("i32", "i16"))),
    ]:
        add(f"frame_of_reference/{name}{place}/{wide}/{narrow}", frame_of_reference.decode, parts, ("segment_length", "word", "model"), word=wide, stored=narrow, model=name, index=i)
    for wide in sizes:
        add(f"bitmaps/{u(wide)}/dictionary", bitmaps.decode, {"incidence_bitmaps": ("bitmap", "container", "bits"), "dictionary_entries": ("code", "value")}, index=4)
    add("bitmaps/u8", bitmaps.decode, {"incidence_bitmaps": ("bitmap", "container", "bits")}, ("word",), word="u8", index=4)
    for name, wide, i in (("linear", "i16", 4), ("linear", "i32", 4), ("linear", "i32", 8), ("constant", "i16", 4), ("constant", "i32", 4)):
        add(f"model/{name}/{wide}", model.decode, {}, ("model", "model_coefficients", "word"), word=wide, model=name, index=i)
    parts = {"runs": ("run", "value", "length"), "anchors": ("seg", "run", "intra_run_offset")}
    for wide, size, i in [*((w, r, 4) for r in (1, 2, 4) for w in sizes), *((4, r, 8) for r in (1, 2, 4)), *((w, 8, 8) for w in (1, 4, 8))]:
        add(f"rle/{u(wide)}/{u(size)}", rle.decode, parts, ("segment_length",), lengths=u(size), index=i)
    parts = {"runs": ("run", "value", "start"), "anchors": ("seg", "run")}
    for kind, wide, size, i in [*(("relative", w, 2, 4) for w in sizes), ("relative", 4, 2, 8), *(("absolute", w, 4, 4) for w in sizes), ("absolute", 4, 8, 8)]:
        add(f"rpe/{kind}/{u(wide)}/{u(size)}", rpe.decode, parts, ("segment_length",), positions=u(size), index=i)
    return out


REGISTRY = standard()
