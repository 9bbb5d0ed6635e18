"""Window notations of the language and the configuration, in one form."""

from __future__ import annotations

from dataclasses import dataclass

UNLIMITED = 0x7FFFFFFF
_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 7 * 86400, "y": 365 * 86400}


class FrameError(ValueError):
    """A text that is not a window."""


def seconds(text: str | int) -> int:
    """A duration in seconds; a bare number counts as seconds."""
    text = str(text)
    if text.isdigit():
        return int(text)
    if len(text) < 2 or text[-1] not in _SECONDS or not text[:-1].isdigit():
        raise FrameError(f"not a duration: {text!r}")
    return int(text[:-1]) * _SECONDS[text[-1]]


@dataclass(frozen=True)
class Frame:
    """rows: high rows back to low rows back. range: high to low microseconds back, the max_rows latest of them."""

    kind: str
    high: int
    low: int
    max_rows: int = UNLIMITED

    @property
    def capped(self) -> bool:
        return self.kind == "range" and self.max_rows < UNLIMITED


def parse_frame(text: str) -> Frame:
    """high:limit:low, rows:low, duration:duration, and the configuration's high[,limit][:low]."""
    parts = text.replace(",", ":").split(":") if text.count(",") == 1 else text.split(":")
    if "," in text and len(parts) == 2:  # high,limit without a low
        parts.append("0s")
    if len(parts) == 1:
        parts.append("0" if parts[0].isdigit() else "0s")
    if len(parts) not in (2, 3) or not all(parts):
        raise FrameError(f"not a window: {text!r}")
    high, low = parts[0], parts[-1]
    limit = UNLIMITED if len(parts) == 2 else int(parts[1])
    if limit < 1:
        raise FrameError(f"a window of no rows: {text!r}")
    if len(parts) == 2 and (high.isdigit() or low.isdigit()):
        if not (high.isdigit() and low.isdigit()):
            raise FrameError(f"rows and durations mixed: {text!r}")
        frame = Frame("rows", int(high), int(low))
    else:
        frame = Frame("range", seconds(high) * 1_000_000, seconds(low) * 1_000_000, limit)
    if frame.low > frame.high:
        raise FrameError(f"a window that ends before it starts: {text!r}")
    return frame


def from_config(text: str) -> str:
    """A configured window in the language's notation."""
    high, _, low = str(text).partition(":")
    if high.isdigit():
        return f"{high}:{low or '0'}"
    high, _, limit = high.partition(",")
    return f"{high}:{limit or UNLIMITED}:{low or '0s'}"


def candidate_windows(gap_s: float, span_s: float, delay: str = "0s", candidates: tuple[str, ...] = ("2h", "10h", "2d", "7d", "14d", "32d", "64d", "366d"), limit: int = 1000, binary: bool = True) -> list[str]:
    """Up to two windows that suit a table's smallest time gap and its time span."""
    lag = seconds(delay)
    sizes = sorted(seconds(c) for c in candidates)
    if binary:  # the longest that fit the span; the shortest candidate is never one of them
        picked = [c for c in sizes[1:] if c < span_s][-2:][::-1]
    else:  # the shortest beyond the gap and the delay
        picked = [c for c in sizes if c > gap_s and c > lag][:2]
    return [f"{c}s,{limit}:{lag}s" for c in picked] or [f"10000d,{limit}:{lag}s"]
