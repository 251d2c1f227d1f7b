"""A change narrowed to the files of a task."""

from codeloom.operators import change


def test_only_what_starts_in_the_files_stays():
    row = lambda i, via, depth: {"id": i, "via_target": via, "depth": depth}
    result = {
        "changed": [{"id": "a", "file": "x.ts"}, {"id": "b", "file": "y.ts"}],
        "callers": [row("c", "a", 1), row("d", "b", 1)],
        "impact": [row("g", "f", 3), row("f", "c", 2), row("h", "d", 2)],
        "dependents": [{"file": "p", "changed_file": "x.ts"}, {"file": "q", "changed_file": "y.ts"}],
        "paths": [{"changed_id": "a"}, {"changed_id": "b"}],
        "tests": [],
    }
    got = change.narrowed(result, {"x.ts"})
    assert [r["id"] for r in got["changed"]] == ["a"] and [r["id"] for r in got["callers"]] == ["c"]
    assert [r["id"] for r in got["impact"]] == ["f", "g"]
    assert [r["file"] for r in got["dependents"]] == ["p"] and [r["changed_id"] for r in got["paths"]] == ["a"]
    assert change.narrowed(result, set())["impact"] == []
