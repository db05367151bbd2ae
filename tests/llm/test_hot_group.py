"""A group of op10 that outgrows CHUNK keeps every run with a new window."""

import pandas as pd

from tracewell.llm import repeats


def test_run_with_new_middle_window_stays(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 300)
    core = "".join(chr(97 + k * k % 26) + str(k % 10) for k in range(47))[:93]
    texts = ["aaaaaaa" + core + "0000000", "bbbbbbb" + core + "1111111", "aaaaaaa" + core + "1111111", "zzzzaaa" + core + "1111zzz"]
    rows = pd.DataFrame([(7, d, 37, 37, 30, t.encode()) for d, t in enumerate(texts)], columns=["gram", "d", "place", "lead", "tail", "raw"]).assign(t=0)
    out = pd.concat(repeats._by_gram(iter([rows.iloc[:3], rows.iloc[3:]])))
    assert (4, 104) in set(out.loc[out.d == 3, ["a", "z"]].itertuples(index=False, name=None))
