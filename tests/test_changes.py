"""Edges after changes are those of a full resolution, and few of them are made again."""

import random

import pytest

from symgraph.api import Workspace
from symgraph.operators import resolve


def _java(rng, k, names):
    fields = "".join(f"    @Autowired\n    {rng.choice(names)} f{j};\n" for j in range(rng.randint(0, 2)))
    calls = " ".join(f"{rng.choice(['', rng.choice(names)[0].lower() + rng.choice(names)[1:] + '.'])}m{rng.randint(0, 5)}();" for _ in range(3))
    imports = "".join(rng.choice([f"import p.{rng.choice(names)};\n", "import p.*;\n", "import q.Deep;\n"]) for _ in range(2))
    note = rng.choice(["@Service\n", '@RequestMapping("/k")\n', ""])
    heirs = rng.choice(["", f" extends {rng.choice(names)}", f" implements {rng.choice(names)}"])
    served = f'    @GetMapping("/v{rng.randint(0, 2)}")\n' if rng.random() < 0.5 else ""
    return f"package p;\n{imports}\n{note}public class {names[k % len(names)]}{heirs} {{\n{fields}{served}    public void m{rng.randint(0, 5)}() {{ {calls} }}\n}}\n"


def _ts(rng, k):
    return f"import {{ x }} from './{rng.choice(['a', 'b', 'c'])}'\nexport function Page{k}() {{\n  fetch('/k/v{rng.randint(0, 2)}')\n  return <Row{rng.randint(0, 2)}/>\n}}\nexport function Row{rng.randint(0, 2)}() {{ return m{rng.randint(0, 5)}() }}\n"


def _edges(w):
    return sorted((r.source_id, r.target_id, r.kind, r.metadata or "", r.resolver, r.seq) for r in w.tables["edges"].collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_edges_after_changes_equal_a_full_resolution(spark, tmp_path, seed):
    rng = random.Random(seed)
    names = ["Alpha", "Beta", "BetaStore", "Gamma", "Delta"]

    def write(k):
        (tmp_path / f"p/C{k}.java").write_text(_java(rng, k, names))
        (tmp_path / f"w/{'abcdef'[k % 6]}.tsx").write_text(_ts(rng, k))

    (tmp_path / "p").mkdir()
    (tmp_path / "w").mkdir()
    for k in range(6):
        write(k)
    w = Workspace(spark).scan(str(tmp_path), "m")
    assert len(_edges(w)) > 10
    write(rng.randrange(8))
    (tmp_path / f"p/C{rng.randrange(6)}.java").unlink(missing_ok=True)
    (tmp_path / "w/b.tsx").unlink(missing_ok=True)
    w.scan(str(tmp_path), "m")
    assert _edges(w) == sorted((r.source_id, r.target_id, r.kind, r.metadata or "", r.resolver, r.seq) for r in resolve.resolve_all(w.tables).collect())


def test_a_small_change_touches_few_sources(spark, tmp_path, monkeypatch):
    for k in range(60):
        (tmp_path / f"C{k}.java").write_text(f"package p;\npublic class C{k} {{\n    public void go{k}() {{ c{(k + 1) % 60}.go{(k + 1) % 60}(); }}\n}}\n")
    w = Workspace(spark).scan(str(tmp_path), "m")
    assert len(_edges(w)) == 60
    (tmp_path / "C7.java").write_text("package p;\npublic class C7 {\n    public void went7() { c8.go8(); }\n}\n")
    asked = []
    real = resolve._resolved
    monkeypatch.setattr(resolve, "_resolved", lambda t, of: asked.append(of) or real(t, of))
    w.scan(str(tmp_path), "m")
    assert asked[0].count() <= 4 and len(_edges(w)) == 59
