"""The worker's index belongs to the chunk it is asked for, also when a freed chunk's id returns."""

from types import SimpleNamespace

from ledgerlens.llm import decontaminate


def test_index_of_each_chunk():
    seen = set()
    for n in range(50):
        rows = SimpleNamespace(value=tuple([[n], [f"some item of six words{n}"]]))
        seen.add(id(rows.value))
        index = decontaminate._index(rows, 3, 0.75)
        assert index.ids == [n] and decontaminate._index(rows, 3, 0.75) is index
        assert decontaminate._index(rows, 5, 0.75).radius == 5
        del rows, index
    assert len(seen) < 50                                   # ids did return
