"""One object for a mode with its dictionary and model: strings on the driver, columns on the cluster, with the same tokens."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.annotate import FALLBACK, SHORT
from . import kernel, modes
from .lattice import Model
from .ngram import BigramModel


@dataclass(frozen=True)
class Tokenizer:
    """mode and what it needs; see `modes.segment`. Texts that aren't strings are a TypeError; None gives None in `tokens`, and '' no tokens."""

    mode: str | None = None
    lexicon: kernel.Lexicon | None = None
    model: BigramModel | Model | None = None
    info: Mapping[str, float] = field(default_factory=dict)
    readings: modes.Readings | None = None
    seed: int = 0

    def _engine(self, every: bool = False, temperature: float = 0.0) -> modes.Segmenter:
        if temperature < 0:
            raise ValueError("temperature can't be negative")
        mode = modes.resolve(self.mode)
        return modes.Segmenter(replace(mode, decider=None) if every else mode, self.lexicon, self.model, True, temperature, self.seed, self.info, self.readings)

    def tokens(self, text: str | None, every: bool = False, temperature: float = 0.0) -> list[dict] | None:
        """Tokens as dicts text, st, et, atom_s, atom_e, labels; every: all candidates instead of a path."""
        if text is not None and not isinstance(text, str):
            raise TypeError("a text is a string")
        return self._engine(every, temperature).tokens(pa.array([text], pa.string()))[0]

    def lcut(self, text: str, every: bool = False, temperature: float = 0.0) -> list[str]:
        if text is None:
            raise TypeError("a text is a string")
        return [t["text"] for t in self.tokens(text, every, temperature)]

    __call__ = lcut

    def cut(self, text: str, every: bool = False) -> Iterator[str]:
        yield from self.lcut(text, every)

    def batch_cut(self, texts: Iterable[str], every: bool = False) -> Iterator[list[str]]:
        yield from (self.lcut(t, every) for t in texts)

    def sample(self, text: str, temperature: float = 0.5) -> list[str]:
        return self.lcut(text, temperature=temperature)

    def tokenize(self, text: str, mode: str = "default") -> list[tuple[str, int, int]]:
        """(text, start, end): of the path, or of all candidates in search order: by start, the longest first, then by text."""
        if mode not in ("default", "search"):
            raise ValueError("mode is default or search")
        found = [(t["text"], t["st"], t["et"]) for t in self.tokens(text, mode == "search")]
        return found if mode == "default" else sorted(found, key=lambda x: (x[1], x[1] - x[2], x[0]))

    def lac(self, text: str) -> list[tuple[str, str]]:
        """(text, short tag) of each token."""
        return [(t["text"], short_tag(t["labels"])) for t in self.tokens(text)]

    def segment(self, df: DataFrame, text: str = "text", out: str = "tokens", **options) -> DataFrame:
        """The same over a column."""
        return modes.segment(df, self.mode, text, out, lexicon=self.lexicon, model=self.model, info=self.info, readings=self.readings, seed=self.seed, **options)


def short_tag(labels: Iterable[str]) -> str:
    """`annotate.select_pos` for one set of labels."""
    own = set(labels)
    first = min((x for x in own if x.startswith("POS_")), default=None)
    if first is not None:
        return SHORT.get(first, first[4:].lower())
    return next((tag for label, tag in FALLBACK if label in own), "xc")
