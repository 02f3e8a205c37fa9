"""What a model must be able to do to take part, and compositions of models. Models themselves are outside."""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np

Segments = list[tuple[float, float, str]]


class Transcriber(ABC):
    """Audio to text."""

    @abstractmethod
    def transcribe(self, samples: np.ndarray, rate: int) -> str: ...


class TimedTranscriber(Transcriber):
    """Audio to (start, end, text) segments, in seconds; its text is theirs, joined."""

    @abstractmethod
    def transcribe_timed(self, samples: np.ndarray, rate: int) -> Segments: ...

    def transcribe(self, samples: np.ndarray, rate: int) -> str:
        return " ".join(t for _, _, t in self.transcribe_timed(samples, rate))


class ContextualTranscriber(Transcriber):
    """Audio to text, given what was said before."""

    @abstractmethod
    def transcribe_after(self, samples: np.ndarray, rate: int, history: str) -> str: ...

    def transcribe(self, samples: np.ndarray, rate: int) -> str:
        return self.transcribe_after(samples, rate, "")


class CTC(Transcriber):
    """Audio to a matrix of log probabilities, a row for each tick; its text is the greedy path."""

    blank: int
    #: Seconds between two rows.
    tick: float

    @abstractmethod
    def log_probabilities(self, samples: np.ndarray, rate: int) -> np.ndarray: ...

    @abstractmethod
    def decode(self, token: int) -> str: ...

    def transcribe(self, samples: np.ndarray, rate: int) -> str:
        return self.text_of(self.log_probabilities(samples, rate))

    def text_of(self, matrix: np.ndarray) -> str:
        best = np.asarray(matrix).argmax(1) if len(matrix) else np.zeros(0, int)
        fresh = np.ones(len(best), bool)
        fresh[1:] = best[1:] != best[:-1]
        return "".join(self.decode(int(k)) for k in best[fresh] if k != self.blank)


class Segmenter(ABC):
    """Audio to (start, end) of its parts, in seconds."""

    @abstractmethod
    def segments(self, samples: np.ndarray, rate: int) -> list[tuple[float, float]]: ...


class Corrector(ABC):
    """Text to better text."""

    @abstractmethod
    def correct(self, text: str) -> str: ...


class StreamingTranscriber(ABC):
    """Audio, chunk by chunk, to (uid, text) changes: a uid told again replaces its text. One instance hears one recording."""

    @abstractmethod
    def push(self, samples: np.ndarray, rate: int) -> list[tuple[str | None, str]]: ...

    def finish(self) -> list[tuple[str | None, str]]:
        return []


def bell(n: int) -> np.ndarray:
    """Weights of n ticks of one piece: the density of a beta distribution of 5 and 5, which trusts the middle most, and a little everywhere."""
    x = np.linspace(0, 1, n) if n > 1 else np.zeros(n)
    return 0.01 + 630 * x**4 * (1 - x) ** 4


def average_overlapping(pieces: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Rows for each tick from overlapping pieces (first tick, matrix), weighted by a bell over each; a tick no piece has is an error."""
    if not pieces:
        return np.zeros((0, 0))
    n = max(at + len(m) for at, m in pieces)
    total, weight = np.zeros((n, pieces[0][1].shape[1])), np.zeros(n)
    for at, m in pieces:
        w = bell(len(m))
        total[at : at + len(m)] += m * w[:, None]
        weight[at : at + len(m)] += w
    if not weight.all():
        raise ValueError("ticks that no piece covers")
    return total / weight[:, None]


def piece_bounds(length: int, segment: int, shift: int) -> list[tuple[int, int]]:
    """[0, length) in pieces of ``segment``, ``shift`` apart; the last ends with it and is as long as the others."""
    if length <= segment:
        return [(0, length)]
    starts = [*range(0, length - segment, shift), length - segment]
    return [(s, s + segment) for s in starts]


class LongformCTC(CTC):
    """A CTC model of short audio over long audio: overlapping pieces, their probabilities averaged, decoded as one."""

    def __init__(self, model: CTC, segment_s: float = 30.0, shift_s: float = 5.0):
        self.model, self.segment_s, self.shift_s, self.blank, self.tick = model, segment_s, shift_s, model.blank, model.tick

    def decode(self, token: int) -> str:
        return self.model.decode(token)

    def log_probabilities(self, samples: np.ndarray, rate: int) -> np.ndarray:
        pieces = []
        for a, b in piece_bounds(len(samples), int(self.segment_s * rate), int(self.shift_s * rate)):
            pieces.append((round(a / rate / self.tick), np.exp(self.model.log_probabilities(samples[a:b], rate))))
        return np.log(average_overlapping(pieces))


class LongformVAD(TimedTranscriber):
    """A model of short audio over the voiced segments of long audio; a contextual one is told the last ``history`` words."""

    def __init__(self, model: Transcriber, segmenter: Segmenter, short_s: float = 30.0, history: int = 100):
        self.model, self.segmenter, self.short_s, self.history = model, segmenter, short_s, history

    def transcribe_timed(self, samples: np.ndarray, rate: int) -> Segments:
        whole = len(samples) / rate
        spans = [(0.0, whole)] if whole < self.short_s else self.segmenter.segments(samples, rate)
        out: Segments = []
        said: list[str] = []
        for a, b in spans:
            part = samples[int(a * rate) : int(b * rate)]
            if isinstance(self.model, ContextualTranscriber):
                text = self.model.transcribe_after(part, rate, " ".join(said[-self.history :]))
            else:
                text = self.model.transcribe(part, rate)
            said += text.split()
            out.append((a, b, text))
        return out


class OfflineToStreaming(StreamingTranscriber):
    """A model of whole audio as a streaming one: after every ``interval_s`` of audio all heard so far is transcribed anew, under one uid."""

    def __init__(self, model: Transcriber, interval_s: float = 0.5, most_s: float = 30.0):
        self.model, self.interval_s, self.most_s = model, interval_s, most_s
        self.heard, self.waiting, self.rate = np.zeros(0), np.zeros(0), 0

    def push(self, samples: np.ndarray, rate: int) -> list[tuple[str | None, str]]:
        self.rate, self.waiting, out = rate, np.concatenate([self.waiting, samples]), []
        step = max(1, int(self.interval_s * rate))
        while len(self.waiting) >= step:
            out.append(self._hear(step))
        return out

    def finish(self) -> list[tuple[str | None, str]]:
        return [self._hear(len(self.waiting))] if len(self.waiting) else []

    def _hear(self, n: int) -> tuple[str, str]:
        self.heard, self.waiting = np.concatenate([self.heard, self.waiting[:n]]), self.waiting[n:]
        if len(self.heard) >= self.most_s * self.rate:
            raise ValueError("audio too long to be transcribed anew each time")
        return "0", self.model.transcribe(self.heard, self.rate)


class StreamingToOffline(Transcriber):
    """A streaming model as one of whole audio: all chunks at once, then the text that stands."""

    def __init__(self, make, chunk_s: float = 1.0):
        self.make, self.chunk_s = make, chunk_s

    def transcribe(self, samples: np.ndarray, rate: int) -> str:
        texts: dict[object, str] = {}
        for *_, changes in stream(self.make(), samples, rate, self.chunk_s):
            for uid, text in changes:
                texts[object() if uid is None else uid] = text
        return " ".join(texts.values())


def stream(model: StreamingTranscriber, samples: np.ndarray, rate: int, chunk_s: float):
    """(seconds sent, is the end, changes) for each chunk of an audio that a streaming model is given, and for its end."""
    step = max(1, int(chunk_s * rate))
    for a in range(0, len(samples), step):
        part = samples[a : a + step]
        yield (a + len(part)) / rate, False, model.push(part, rate)
    yield len(samples) / rate, True, model.finish()
