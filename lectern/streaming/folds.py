"""Order-sensitive rules of live captions as plain folds: step(state, row) gives the next state and the rows to emit. Batch
and streaming operators call the same folds."""
from __future__ import annotations

#: Endings that complete a line, its longest size, silence and near silence (RMS), age and pause in ms.
ENDINGS = tuple(".!?…。！？؟،;:")
CAPTION_ENDINGS = tuple(".!?…。！？؟;:")
COMMIT_CHARS = 160
SILENCE_RMS, QUIET_RMS = 0.0001, 0.001
OLDEST_MS, PAUSE_MS = 6000, 2200


def words_overlap(left: list[str], right: list[str], most: int | None = None) -> int:
    """The longest suffix of the left, in words and case aside, that the right begins with."""
    a, b = [w.casefold() for w in left], [w.casefold() for w in right]
    top = min(len(a), len(b), most if most is not None else len(a))
    return next((n for n in range(top, 0, -1) if a[-n:] == b[:n]), 0)


def merge_caption(left: str, right: str) -> str:
    """A growing caption: the right where it contains the left's beginning, the left where it ends with the right, else both
    without the words they share at the seam."""
    left, right = " ".join((left or "").split()), " ".join((right or "").split())
    a, b = left.lower(), right.lower()
    if not left or (right and b.startswith(a)):
        return right
    if not right or a.endswith(b):
        return left
    x, y = left.split(" "), right.split(" ")
    return " ".join(x + y[words_overlap(x, y) :])


def live_line(pending: str, text: str | None, rms: float, credit: bool = False, flush: bool = False) -> tuple[str, list[str]]:
    """(what stays pending, committed lines) after one chunk: silence and a flush commit what is pending, a made-up credit
    line counts only where it is loud enough to be speech, and a line is complete at its mark or its size."""
    if rms < SILENCE_RMS or flush:
        return "", [pending] if pending else []
    text = (text or "").strip()
    if not text or (credit and rms < QUIET_RMS):
        return pending, []
    pending = f"{pending} {text}".strip()
    return ("", [pending]) if pending.endswith(ENDINGS) or len(pending) >= COMMIT_CHARS else (pending, [])


def caption_buffer(state: tuple[str, int, int], at: int, text: str | None) -> tuple[tuple[str, int, int], list[str]]:
    """One growing caption of time `at` (ms) into (pending, begun, last): a pause commits what was pending before it; then the
    caption is merged, and committed at its mark, its size or its age."""
    pending, begun, last = state
    out = []
    if pending and at - last >= PAUSE_MS:
        out.append(pending)
        pending = ""
    begun = begun if pending else at
    pending = merge_caption(pending, text or "")
    if pending and (pending.endswith(CAPTION_ENDINGS) or len(pending) >= COMMIT_CHARS or at - begun >= OLDEST_MS):
        out.append(pending)
        pending = ""
    return (pending, begun, at), out


def confirmed_prefix(previous: list[str], committed: int, hypothesis: str | None) -> tuple[list[str], list[str], str]:
    """(this hypothesis, words that it commits, the rest): words that two hypotheses in turn begin with are committed for
    good; `committed` says how many were before."""
    now = (hypothesis or "").split()
    same = 0
    while same < min(len(previous), len(now)) and previous[same].casefold() == now[same].casefold():
        same += 1
    added = now[committed:same]
    return now, added, " ".join(now[committed + len(added) :])


def kept_apart(last: tuple[str, float | None] | None, text: str, at: float | None, gap: float = 3.0) -> bool:
    """Whether a caption is new against the last one kept: another text, or one at least `gap` seconds away."""
    if last is None or last[0] != text.lower():
        return True
    return at is not None and last[1] is not None and abs(at - last[1]) >= gap
