"""Guards over streams of samples from running drives.

Samples without a device, a time or a counter are void; a missing temperature leaves the heat state as it is; late
samples are taken in the order in which they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

GUARD_STATE = "last_us double, last_bytes double, baseline double, slow_since double, hot boolean, throttled boolean, rates array<double>"
GUARD_OUT = "device bigint, ts timestamp, event string"


def guard_stream(samples: DataFrame, pause: float = 55, resume: float = 50, baseline_s: float = 90, slow_s: float = 60) -> DataFrame:
    """Events of a stream of ``device, ts, bytes_done, temperature``: pauses and resumes by heat and by loss of speed.

    The median rate of the first ``baseline_s`` seconds is the baseline; below half of it for ``slow_s`` seconds
    is a throttle, which ends at half of it or after ten times that wait, with a new baseline.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s = dict(zip(("last", "bytes", "base", "slow", "hot", "thr", "rates"), state.get if state.exists else (None, None, None, None, False, False, [])))
        s["rates"], first = list(s["rates"] or []), None
        out = []
        for r in pd.concat(list(frames)).sort_values(["ts", "bytes_done"]).itertuples():
            now = r.ts.timestamp()
            if r.temperature == r.temperature and r.temperature is not None:
                if not s["hot"] and r.temperature >= pause:
                    s["hot"] = True
                    out.append((key[0], r.ts, "pause: heat"))
                elif s["hot"] and r.temperature <= resume:
                    s["hot"] = False
                    out.append((key[0], r.ts, "resume: heat"))
            if s["last"] is not None and now > s["last"]:
                rate = (r.bytes_done - s["bytes"]) / (now - s["last"])
                if s["base"] is None:
                    s["rates"] += [rate] if rate > 0 else []
                    s["slow"] = now if s["slow"] is None else s["slow"]
                    if now - s["slow"] >= baseline_s and s["rates"]:
                        s["base"], s["rates"], s["slow"] = sorted(s["rates"])[len(s["rates"]) // 2], [], None
                elif rate < 0.5 * s["base"]:
                    s["slow"] = now if s["slow"] is None else s["slow"]
                    if not s["thr"] and now - s["slow"] >= slow_s:
                        s["thr"] = True
                        out.append((key[0], r.ts, "pause: speed"))
                    elif s["thr"] and now - s["slow"] >= 10 * slow_s:
                        s.update(thr=False, base=None, slow=None)
                        out.append((key[0], r.ts, "resume: speed"))
                else:
                    if s["thr"]:
                        s.update(thr=False, base=None)
                        out.append((key[0], r.ts, "resume: speed"))
                    s["slow"] = None
            s["last"], s["bytes"] = now, float(r.bytes_done)
        state.update((s["last"], s["bytes"], s["base"], s["slow"], s["hot"], s["thr"], s["rates"]))
        yield pd.DataFrame(out, columns=["device", "ts", "event"])

    return samples.where("device IS NOT NULL AND ts IS NOT NULL AND bytes_done IS NOT NULL").groupBy("device").applyInPandasWithState(step, GUARD_OUT, GUARD_STATE, "append", "NoTimeout")
