"""Report deltas as a stream: paragraph messages from a state per run."""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The functions and the processor below travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT = "run_id string, msg_no bigint, output string"
# ``n`` deltas of a run with numbers from ``seq`` on: their joined text, where each ends in it, which of them hold a line break,
# and whether the last ends the run.  The two lists are whole numbers of four bytes.
STRETCH = "run_id string, seq bigint, n bigint, text string, ends binary, breaks binary, is_end boolean"


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deltas (run_id, seq, delta, is_end) as STRETCH, as far as they follow each other within a batch in any order.

    A null delta is an empty one.  Of one number that comes twice in a batch the first stays."""
    for batch in batches:
        if not batch.num_rows:
            continue
        run = pc.dictionary_encode(batch["run_id"], null_encoding="encode")
        code, seq = run.indices.to_numpy(), batch["seq"].to_numpy(zero_copy_only=False)
        if batch["seq"].null_count:
            raise ValueError("a delta has no number")
        order = np.lexsort((seq, code))  # stable: of equals the first comes first
        code, seq = code[order], seq[order]
        fresh = np.append(True, (code[1:] != code[:-1]) | (seq[1:] != seq[:-1]))
        order, code, seq = order[fresh], code[fresh], seq[fresh]
        deltas = pc.fill_null(batch["delta"].take(pa.array(order)), "")
        last = pc.fill_null(batch["is_end"].take(pa.array(order)), False).to_numpy(zero_copy_only=False)
        breaks = pc.match_substring(deltas, "\n").to_numpy(zero_copy_only=False)
        ends, text = np.cumsum(pc.utf8_length(deltas).to_numpy()), "".join(deltas.to_pylist())
        starts = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (seq[1:] != seq[:-1] + 1) | last[:-1]))
        stops = np.append(starts[1:], len(seq))
        before = np.append(0, ends)[starts]
        rows = {
            "run_id": run.dictionary.take(pa.array(code[starts])),
            "seq": seq[starts],
            "n": stops - starts,
            "text": [text[i:j] for i, j in zip(before, ends[stops - 1])],
            "ends": [(ends[i:j] - at).astype("<i4").tobytes() for i, j, at in zip(starts, stops, before)],
            "breaks": [np.flatnonzero(breaks[i:j]).astype("<i4").tobytes() for i, j in zip(starts, stops)],
            "is_end": last[stops - 1],
        }
        yield pa.RecordBatch.from_pydict(rows)


def _numbers(held: bytes) -> list[int]:
    return np.frombuffer(held, "<i4").tolist()


class Paragraphs(StatefulProcessor):
    """Per run: where it stands, deltas that came early, and whether it is over.

    ``early`` is a map by number, so a delta that waits is written once and not with every batch again.
    ``over`` is what remains of an ended run; it expires, if at all, by its own time to live."""

    def __init__(self, idle_ms: int | None, remember_ms: int | None) -> None:
        self.idle_ms, self.remember_ms = idle_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "buffer string, msg_no bigint, next_seq bigint, waiting bigint")
        self.early = handle.getMapState("early", "seq bigint", "delta string, is_end boolean")
        self.over = handle.getValueState("over", "broken boolean", self.remember_ms)

    def _close(self, had_place: bool, waited: int, broken: bool) -> None:
        if waited:
            self.early.clear()
        if had_place:
            self.place.clear()
        self.over.update((broken,))

    def _wake(self, now: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stored = self.place.get()
        if stored is None and self.over.get() is not None:
            for _ in rows:  # sent again, or sent after the run was given up
                pass
            return
        buffer, msg_no, next_seq, waited = stored or ("", 0, 0, 0)
        waiting, pieces, ended, held = waited, [buffer], False, []
        for place, row in enumerate(rows):
            if not ended:
                heapq.heappush(held, (row.seq, place, row))
            while not ended:
                if held and held[0][0] <= next_seq:
                    _, _, found = heapq.heappop(held)
                    skipped = next_seq - found.seq
                    if skipped >= found.n:
                        continue
                    ends = _numbers(found.ends)
                    at, next_seq, ended = ends[skipped - 1] if skipped else 0, found.seq + found.n, found.is_end
                    for broken in _numbers(found.breaks):
                        if broken >= skipped:
                            yield Row(run_id=key[0], msg_no=msg_no, output="".join(pieces) + found.text[at : ends[broken]])
                            msg_no, pieces, at = msg_no + 1, [], ends[broken]
                    pieces.append(found.text[at:])
                elif waiting and (kept := self.early.getValue((next_seq,))) is not None:
                    delta, ended = kept
                    self.early.removeKey((next_seq,))
                    waiting, next_seq = waiting - 1, next_seq + 1
                    pieces.append(delta or "")
                    if "\n" in pieces[-1]:
                        yield Row(run_id=key[0], msg_no=msg_no, output="".join(pieces))
                        msg_no, pieces = msg_no + 1, []
                else:
                    break
        if ended:
            # The tail without a line break is not sent.
            self._close(stored is not None, waiting, False)
            if self.idle_ms is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
            return
        written = set()
        for _, _, row in sorted(held, key=lambda r: r[1]):
            ends = [0, *_numbers(row.ends)]
            for i, seq in enumerate(range(row.seq, row.seq + row.n)):
                # Numbers passed meanwhile are repeats; of a number that waits already the first stays.
                if seq >= next_seq and seq not in written and not (waited and self.early.containsKey((seq,))):
                    self.early.updateValue((seq,), (row.text[ends[i] : ends[i + 1]], row.is_end and i + 1 == row.n))
                    written.add(seq)
        waiting += len(written)
        self.place.update(("".join(pieces), msg_no, next_seq, waiting))
        if self.idle_ms is not None:
            self._wake(timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.place.exists():
            _, msg_no, _, waiting = self.place.get()
            self._close(True, waiting, True)
            yield Row(run_id=key[0], msg_no=msg_no, output=None)


def stream_report_messages(
    deltas: DataFrame, idle_ms: int | None = None, remember_ms: int | None = None
) -> DataFrame:
    """Messages of a delta stream (run_id, seq, delta, is_end): run_id, msg_no, output.

    Deltas of a run are numbered from 0 and may arrive in any order and more than once: one
    that is early waits in the state for those before it.  Deltas that follow each other in a batch of rows as read go on as one
    row, so what is shuffled and handed to a state is a row per run and such batch.  A run's state is one unfinished
    paragraph and what waits.  Once all up to its end marker are in, one flag remains, so that deltas that
    are delivered again send nothing; ``remember_ms`` bounds how long (None: for good).
    A stream that never stops should give ``idle_ms`` too: a run without deltas for so long is given up.
    One row with a null output and the number of the message that was due says so; its state goes, and what it sends later is ignored
    like the deltas of an ended run.  A stream read with ``availableNow`` must give neither, as one that keeps time never ends.

    Start it under :func:`dossier.streaming.state.disk_state`: the state needs a store on disk.
    """
    timed = idle_ms is not None or remember_ms is not None
    joined = deltas.select("run_id", "seq", "delta", "is_end").mapInArrow(stretches, STRETCH)
    return joined.groupBy("run_id").transformWithState(
        Paragraphs(idle_ms, remember_ms), OUTPUT, "append", "ProcessingTime" if timed else "None"
    )
