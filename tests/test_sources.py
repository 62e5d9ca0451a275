"""File trees and settings files."""

from pyspark.sql import functions as F

from sievehouse.sources import files


def test_read_tree(spark, tmp_path):
    for name, data in {"a/.mcp.json": b"{}", "a/node_modules/x.py": b"no", "b/CLAUDE.md": "é".encode(), "b/m.py": b"a\x00b", "b/big.py": b"x" * 600_000, "c/.env.local": b"", "c/readme.txt": b"no"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    out = {r.path.rsplit("/", 1)[1]: (r.role, r.state, r.text) for r in files.read_tree(spark, str(tmp_path)).collect()}
    assert out == {"CLAUDE.md": ("rules", "read", "é"), "m.py": ("source", "binary", None), "big.py": ("source", "oversized", None)}
    dots = spark.createDataFrame([("/a/.mcp.json", b"{}"), ("/c/.env.local", b""), ("/a/.git/x.py", b"")], "path string, content binary")
    assert {(r.path, r.role, r.state) for r in files.classify(dots).collect()} == {("/a/.mcp.json", "mcp", "read"), ("/c/.env.local", "env", "read")}


def test_names_route_files(spark):
    names = {
        "mcp": ["a/.mcp.json", "a/mcp.json", "a/.gemini/settings.json", "a/.zed/settings.json"],
        "rules": [f"a/{n}" for n in files.RULES if n != "copilot-instructions.md"] + ["a/.github/copilot-instructions.md"],
        "manifest": [f"a/{n}" for n in files.MANIFESTS],
        "env": ["a/.env", "a/.env.local", "a/.env.PROD"],
        "vector": ["a/index.faiss", "a/Index.PKL", "a/x.lance"],
        "source": ["a/b.py", "a/B.TSX", "a/c.mjs", "a/n.ipynb"],
        None: ["a/.env.example", "a/.env.sample", "a/.env.Template", "a/.env.dist", "a/copilot-instructions.md", "a/settings.json", "a/.vscode/settings.json", "a/claude.md", "a/agents.md", "a/pipfile", "a/Package.json", "a/mcp_config.json", "a/x.txt", "a/.envrc"],
    }
    df = spark.createDataFrame([(p, r) for r, ps in names.items() for p in ps], "path string, role string")
    assert [tuple(r) for r in df.where(~files.role_of(F.col("path")).eqNullSafe(F.col("role"))).collect()] == []
    inside = [f"/w/{d}/x.py" for d in files.IGNORED]
    assert files.classify(spark.createDataFrame([(p, b"") for p in inside], "path string, content binary")).count() == 0


def test_settings_and_vectors(spark):
    df = spark.createDataFrame([('{"u": "http://x" /* c */}\n// end',), ("{",), (None,)], "t string")
    assert [r[0] for r in df.select(files.parse_json(F.col("t"))["state"]).collect()] == ["parsed", "unreadable", "absent"]
    env = spark.createDataFrame([("export A_KEY='v'\n# B=1\nC=x y\nlower=1",), (None,)], "t string").select(files.environment_entries(F.col("t")).alias("e")).collect()
    assert [[(x.name, x.value) for x in r.e] for r in env] == [[("A_KEY", "v"), ("C", "x y")], []]
    paths = spark.createDataFrame([("/d/index.faiss",), ("/d/index.pkl",), ("/e/index.pkl",), ("/f/chroma.sqlite3",)], "path string")
    assert {(r.folder, r.engine, tuple(r.files)) for r in files.vector_stores(paths).collect()} == {("/d", "faiss", ("index.faiss", "index.pkl")), ("/f", "chroma", ("chroma.sqlite3",))}
    more = [("/g/Docstore.json",), ("/g/x.py",), ("/h/t.lance",), ("/h/chroma-embeddings.parquet",), ("/i/other.faiss",), (None,), *((f"/j/{i:03}.usearch",) for i in range(30)), ("/j/000.usearch",)]
    found = {r.folder: r for r in files.vector_stores(paths.union(spark.createDataFrame(more, "path string"))).collect()}
    assert {k: (r.engine, r.pickle_backed) for k, r in found.items()} == {"/d": ("faiss", True), "/f": ("chroma", False), "/g": ("llamaindex", False), "/h": ("chroma", False), "/j": ("usearch", False)}
    assert found["/j"].files == [f"{i:03}.usearch" for i in range(20)]
