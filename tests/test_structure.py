import os
import random
import re
import time
import uuid

import pytest

from siltstone.operators import chunk as C
from siltstone.operators import providers as P
from siltstone.operators import structure as T
from siltstone.operators import tables as N

BRACES = {
    "javascript": "import x from 'y';\n\nexport class Store%s {\n  get(key) {\n    return \"}\" + key;\n  }\n}\n\nconst load%s = (a) => {\n  return a;\n};\n",
    "go": "package main\n\ntype Store%s struct {\n\tname string\n}\n\nfunc (s *Store%s) Get() string {\n\treturn s.name // }\n}\n",
    "rust": "use std::fmt;\n\npub struct A%s {\n    x: u8,\n}\n\nimpl A%s {\n    pub fn get(&self) -> u8 {\n        self.x\n    }\n}\n",
    "java": "import java.util.*;\n\npublic class A%s {\n    private int x;\n\n    public int get%s() {\n        return x;\n    }\n}\n",
}


def units(language):
    return [(u[0], u[1], u[2], u[3], u[4]) for u in T.brace_units(BRACES[language].replace("%s", "1"), language)]


def test_brace_units():
    assert units("javascript") == [("module", None, None, 1, 1), ("class_skeleton", "Store1", None, 3, 3), ("function", "get", "Store1", 4, 6), ("function", "load1", None, 9, 11)]
    assert units("go") == [("module", None, None, 1, 1), ("class_skeleton", "Store1", None, 3, 3), ("function", "Get", None, 7, 9)]
    assert units("rust") == [("module", None, None, 1, 1), ("class_skeleton", "A1", None, 3, 3), ("class_skeleton", "A1", None, 7, 7), ("function", "get", "A1", 8, 10)]
    assert units("java") == [("module", None, None, 1, 1), ("class_skeleton", "A1", None, 3, 3), ("function", "get1", "A1", 6, 8)]


def test_python_card(spark):
    source = '"""Does  things.\n\nWell."""\nimport os, sys\nfrom a.b import c\nLIMIT = 1\nlow = 2\nclass A:\n    def run(self): pass\n    def _hide(self): pass\nclass B: pass\ndef f(): pass\n'
    rows = [("p/x.py", source), ("bad.py", "def ("), ("empty.py", "")]
    got = {r["path"]: r["text"] for r in T.python_cards(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got == {"p/x.py": "p/x.py — Python module in package p.\nPurpose: Does things. Well.\nDefines classes: A (methods: run); B.\nDefines functions: f.\nDefines constants: LIMIT.\nDepends on: os, sys, a.b."}


def test_embedding_batches(spark):
    sizes = lambda texts, **k: [len(b) for b in P.embedding_batches(texts, len, **k)]
    assert sizes(["a"] * 130) == [64, 64, 2] and sizes([]) == []
    assert sizes(["aaa", "bb", "c" * 9, "d", ""], tokens=5) == [2, 1, 2]
    assert list(P.embedding_batches(["", " x"], len)) == [[" ", " x"]]
    rows = spark.createDataFrame([(1, "ab"), (2, None)], "k long, t string")
    assert {(r["k"], *r["vector"]) for r in P.ServiceEmbedder(lambda ts: [[float(len(t))] for t in ts]).vectors(rows, "k", "t").collect()} == {(1, 2.0), (2, 1.0)}


def test_requests_are_filled_over_batches_and_made_once(spark, tmp_path):
    log, broken = str(tmp_path / "log"), str(tmp_path / "broken")
    os.makedirs(log)

    def request(texts):
        if "fail" in texts and not os.path.exists(broken):
            open(broken, "w").close()
            raise OSError("busy")
        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(texts)))
        return [[float(len(t)), float(t.count("a"))] for t in texts]

    sizes = lambda: sorted(int(open(f"{log}/{n}").read()) for n in os.listdir(log))
    rows = [(k, "ab" * (k % 150) or None) for k in range(450)] + [(1000, "fail"), (1001, "fail")]
    items = spark.createDataFrame(rows, "k long, t string").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        service = P.ServiceEmbedder(request, store=str(tmp_path / "store"), wait=0.01)
        got = {r["k"]: r["vector"] for r in service.vectors(items, "k", "t", tasks=1).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: [float(len(t or " ")), float((t or " ").count("a"))] for k, t in rows}
    assert sizes() == [23, 64, 64]  # 151 distinct texts: the least number of requests, over batches of seven
    more = spark.createDataFrame([*rows, (2000, "new text")], "k long, t string")
    assert len(service.vectors(more, "k", "t", tasks=1).collect()) == len(rows) + 1 and sizes() == [1, 23, 64, 64]
    assert sorted(os.listdir(tmp_path / "store"))[0][0] != "."  # nothing half written is left
    with pytest.raises(Exception, match="never"):
        P.ServiceEmbedder(lambda texts: (_ for _ in ()).throw(OSError("never")), tries=2, wait=0.0).vectors(items.limit(1), "k", "t").collect()


def test_offline_answers(spark):
    questions = spark.createDataFrame([(1, "what"), (2, "who")], "question_id long, question string")
    sources = spark.createDataFrame([(1, 1, "a.py", 1, 2, "f", "First line. More."), (1, 2, "b.py", None, None, None, "Second.")], "question_id long, rank int, path string, start_line int, end_line int, symbol string, content string")
    got = {r["question_id"]: r["answer"] for r in P.answer(questions, sources, P.ExtractiveChat()).collect()}
    assert got[1] == "First line. [1] Second. [2]" and got[2].startswith("INSUFFICIENT_CONTEXT")
    assert P.OverlapJudge().verdict("the first line", "First line of the text") == "supported"


def parts(source, language):
    return [(u[0], u[1], u[2], u[3], u[4], u[8]) for u in T.brace_units(source, language)]


def texts(source, language):
    return {(u[0], u[1]): u[5] for u in T.brace_units(source, language)}


def test_javascript_by_lexer():
    source = """import x from "y";
export class A extends B {
  get(x) { return /[{]/.test(x) ? `a${x ? `}${"`"}` : "{"}b` : 1; }
  static async set(y) {
    if (y) { foo(y); }
    return y / 2 / 3; // }
  }
  #hid() { return 'don\\'t {' }
}
const f = (a, {b}) => {
  return a;
};
const g = x => x + 1
const h = async (a) =>
  a.b
   .c;
const PORT = 3000;
function k({a, b}, c = {}) {
  return {a};
}
var z = function (q) { return q }
"""
    assert parts(source, "javascript") == [
        ("module", None, None, 1, 1, None), ("class_skeleton", "A", None, 2, 2, 9), ("function", "get", "A", 3, 3, None), ("function", "set", "A", 4, 7, None), ("function", "#hid", "A", 8, 8, None),
        ("function", "f", None, 10, 12, None), ("function", "g", None, 13, 13, None), ("function", "h", None, 14, 16, None), ("module", None, None, 17, 17, None), ("function", "k", None, 18, 20, None), ("function", "z", None, 21, 21, None),
    ]
    assert texts(source, "javascript")["class_skeleton", "A"].splitlines() == ["export class A extends B {", "    " + source.splitlines()[2].strip(), "    static async set(y) {", "    " + source.splitlines()[7].strip()]


def test_typescript_by_lexer():
    source = "interface S<T> {\n  get(x: string): T;\n  name: string;\n}\nexport abstract class C<T> implements S<T> {\n  private x: {a: number} = {a: 1};\n  abstract run(): void;\n  get(x: string): {a: number} {\n    return this.x;\n  }\n  constructor(private readonly y: Y) { super(); }\n}\nexport const fn = async <T>(a: T): Promise<T> => {\n  return a;\n};\nenum E { A, B }\n"
    assert parts(source, "typescript") == [
        ("class_skeleton", "S", None, 1, 1, 4), ("function", "get", "S", 2, 2, None), ("class_skeleton", "C", None, 5, 5, 12), ("function", "run", "C", 7, 7, None), ("function", "get", "C", 8, 10, None), ("function", "constructor", "C", 11, 11, None),
        ("function", "fn", None, 13, 15, None), ("class_skeleton", "E", None, 16, 16, 16),
    ]


def test_rust_go_and_java_by_lexer():
    rust = "struct P<'a> { x: &'a str }\nimpl<'a> fmt::Display for P<'a> {\n    fn fmt(&self, f: &mut fmt::Formatter<'_>) -> fmt::Result {\n        let c = '{'; let s = r#\"}\"{\"#; /* a /* } */ } */\n        write!(f, \"{}\", self.x)\n    }\n}\ntrait Area {\n    fn area(&self) -> f64;\n    fn two(&self) -> u8 { 2 }\n}\nmod inner {\n    pub fn deep() {}\n}\npub(crate) async fn top<T>(t: T) where T: Clone {\n}\n"
    assert parts(rust, "rust") == [
        ("class_skeleton", "P", None, 1, 1, 1), ("class_skeleton", "P", None, 2, 2, 7), ("function", "fmt", "P", 3, 6, None), ("class_skeleton", "Area", None, 8, 8, 11), ("function", "area", "Area", 9, 9, None), ("function", "two", "Area", 10, 10, None),
        ("class_skeleton", "inner", None, 12, 12, 14), ("function", "deep", "inner", 13, 13, None), ("function", "top", None, 15, 16, None),
    ]
    go = "package main\nfunc (s *S) Get(a map[string]interface{}) interface{} {\n\tx := `raw } {`\n\treturn '}'\n}\nfunc F[T any](t T) (int, error) { return 0, nil }\ntype I interface {\n\tDo()\n}\n"
    assert parts(go, "go") == [("module", None, None, 1, 1, None), ("function", "Get", None, 2, 5, None), ("function", "F", None, 6, 6, None), ("class_skeleton", "I", None, 7, 7, 9)]
    java = 'public class A<T> extends B {\n    private int x = foo(1);\n    static { init(); }\n    public A(@Named("x") int y) { this.x = y; }\n    @Override\n    public <R> List<R> get(Map<String, List<T>> m) throws IOException {\n        String s = """\n            } { "quoted"\n            """;\n        return null;\n    }\n    interface Inner {\n        int f(int a);\n    }\n    abstract void g();\n}\n'
    assert parts(java, "java") == [
        ("class_skeleton", "A", None, 1, 1, 16), ("function", "A", "A", 4, 4, None), ("function", "get", "A", 5, 11, None), ("class_skeleton", "Inner", "A", 12, 12, 14), ("function", "f", "Inner", 13, 13, None), ("function", "g", "A", 15, 15, None),
    ]


def test_units_of_odd_sources_take_linear_time():
    for line, language in (("class A {", "javascript"), ("function f(", "javascript"), ("`${", "javascript"), ("const f = (a", "typescript"), ("x(((((", "java"), ("public public x", "java"), ("impl <a", "rust"), ("fn a() { /*", "rust"), ("class A { get(x) {\n return x } }", "javascript"), ("func (", "go"), ("\"'`/{", "javascript")):
        took = []
        for n in (5_000, 20_000):
            began = time.process_time()
            T.brace_units(f"{line}\n" * n, language)
            took.append(time.process_time() - began)
        assert took[1] < max(1.0, 9 * took[0]), (line, took)
    # lines end where str.splitlines() ends them, in strings too
    assert [u[3:5] for u in T.brace_units('function a() { return "x\u2028y" }\nfunction b() {}\n', "javascript")] == [(1, 2), (3, 3)]


def test_windows_as_a_table_function(spark):
    N.register(spark)
    rng = random.Random(2)
    files = {f"p{k}": "\n".join("word " * rng.randint(0, 60) for _ in range(rng.randint(30, 90))) for k in range(6)} | {"one": "x", "long": "y" * 5000 + "\nz"}
    spark.createDataFrame([(p, n + 1, x) for p, t in files.items() for n, x in enumerate(C.plain_lines(t))], "path string, line_no int, line string").repartition(3).createOrReplaceTempView("lines_of_files")
    got = sorted(tuple(r) for r in spark.sql("SELECT path, part, start_line, end_line, header_lines, text FROM windowed_lines(TABLE(SELECT path, line_no, line FROM lines_of_files) PARTITION BY path ORDER BY (line_no), 200)").collect())
    want = [(p, n or 1, a, z, h, x.strip(" ")) for p, t in files.items() for n, _, a, z, h, x in C.windowed_parts(t, 1, C.plain_lines(t)[0], 200)]
    assert got == sorted(want)
    began = time.time()
    lines = ["word " * 5] * 200_000
    assert len(list(C.windowed_parts("\n".join(lines), 1, "head", 200))) > 7_000 and time.time() - began < 5
    N.register_chunker(spark, "paragraphs", lambda path, language, text: ((path, n, x) for n, x in enumerate(text.split("\n\n"))), "path string, n int, text string")
    spark.createDataFrame([("a", "text", "x\n\ny"), ("b.py", "python", None)], "path string, language string, content string").createOrReplaceTempView("files_of_a_user")
    assert sorted(map(tuple, spark.sql("SELECT c.* FROM files_of_a_user f, LATERAL paragraphs(f.path, f.language, f.content) c").collect())) == [("a", 0, "x"), ("a", 1, "y"), ("b.py", 0, "")]
    assert [r["text"] for r in spark.sql("SELECT c.text FROM files_of_a_user f, LATERAL source_chunks(f.path, f.language, f.content) c").collect()] == ["x\n\ny"]


def test_splitter_keeps_to_its_size():
    text = "one two three\n\nfour five " + "x" * 30 + "\nsix"
    got = C.split_characters(text, 12, 4)
    assert all(0 < len(x) <= 12 for x in got) and got[:2] == ["one two", "two three"] and got[-1] == "six"
    assert C.split_characters("", 10, 2) == [] and C.split_characters("ab cd", 10, 2) == ["ab cd"]


def test_skeletons_end_where_their_class_does(spark):
    rows = [("a.py", "python", "class A:\n    x = 1\n    def f(self):\n        pass\n"), ("b.js", "javascript", "class B {\n  f() {}\n}\n")]
    got = {(r["path"], r["kind"]): (r["start_line"], r["end_line"], r["class_end_line"], r["text"]) for r in C.in_batches(spark.createDataFrame(rows, "path string, language string, content string")).collect()}
    assert got["a.py", "class_skeleton"][:3] == (1, 1, 4) and got["b.js", "class_skeleton"] == (1, 1, 3, "class B {\n    f() {}")
    assert got["a.py", "function"][2] is None


def test_budgets_in_true_tokens(spark):
    public = pytest.importorskip("public_tokenizers")
    from functools import partial

    from siltstone.operators.counting import Vocabulary

    count = Vocabulary(public.path("word_bpe_49k.json"))
    rng = random.Random(5)
    line = lambda: " ".join(rng.choice(["word", "é日本", "x==1", "supercalifragilistic", "", "  "]) for _ in range(rng.randint(0, 14)))
    texts = ["\n".join(line() for _ in range(rng.randint(1, 60))) for _ in range(25)] + ["", "\n\n\n", "a " * 900]
    for text in texts:
        lines = text.splitlines()
        assert sum(count.lines(lines)) == count("\n".join(lines)) and len(count.lines(lines)) == len(lines)
        for a, z, body in C.line_windows(text, 60, 2, count):
            assert a == z or count(body) <= 60
        for part, _, a, z, _, body in C.windowed_parts(text, 1, (lines or [""])[0], 80, count):
            assert part is None or a == z or count(body) <= 80 + 1
    code = "class A:\n" + "".join(f"    def f{k}(self):\n        # {line()}\n        return '{'é' * rng.randint(0, 40)}'\n" for k in range(300))
    rows = list(C.structural_rows("a.py", "python", code, count))
    assert all(r[5] == r[6] or count(r[-1]) <= C.CODE_BUDGET for r in rows) and {r[2] for r in rows} == {"class_skeleton", "function"}
    docs = spark.createDataFrame([("a.py", "python", code), ("t", "text", texts[0])], "path string, language string, content string")
    assert C.in_batches(docs, partial(C.structural_rows, count=count)).where("language = 'python'").count() == len(rows)


def test_words_are_encoded_once(monkeypatch):
    """A vocabulary that cuts at white space: counts are sums over words, each encoded once, and equal the library's."""
    public = pytest.importorskip("public_tokenizers")
    from siltstone.operators.counting import Vocabulary

    count, rng = Vocabulary(public.path("word_bpe_49k.json")), random.Random(6)
    assert count.additive
    library = lambda x: len(count.own.encode(x, add_special_tokens=False).ids)
    odd = ["<|endoftext|> x<|startoftext|>y", "\u0301a \u0301b\n\u0301", "a\x1cb \x1fc\nd", "\xa0a\u3000d\x85e", "ΣΑΣ 's't\n's"]
    odd += ["".join(rng.choice(["a", "é", "Σ", "1", " ", "\n", "\t", "<|endoftext|>", "\u0301", "\xa0", "日", "\x1d", "."]) for _ in range(200)) for _ in range(100)]
    for text in odd:
        assert count(text) == library(text) == sum(count.lines(text.split("\n")))
    text = "\n".join(" ".join(rng.choice(["one", "two", "three"]) for _ in range(9)) for _ in range(3000))
    count(text)
    monkeypatch.setattr(Vocabulary, "own", property(lambda self: pytest.fail("known words are encoded again")))
    assert len(C.line_windows(text, 60, 2, count)) > 100 and len(list(C.windowed_parts(text, 1, "one two", 80, count))) > 100


def test_other_vocabularies_are_counted_whole(tmp_path):
    """A vocabulary whose tokens may hold white space isn't taken to add up over lines."""
    tokenizers = pytest.importorskip("tokenizers")
    from siltstone.operators.counting import Vocabulary

    own = tokenizers.Tokenizer(tokenizers.models.BPE({"a": 0, "\n": 1, "\na": 2}, [("\n", "a")]))
    own.save(str(tmp_path / "v.json"))
    count = Vocabulary(str(tmp_path / "v.json"))
    assert not count.additive and count("a\na") == 2 and count.lines(["a", "a"]) == [2, 0]
    assert all(count(body) <= 3 for _, _, body in C.line_windows("a\n" * 6, 3, 0, count))


def test_sections_and_runs_without_a_shuffle(spark):
    """Sections and runs equal loops over lines, each text in its own row, repeated paths included; no plan has an exchange."""
    rng = random.Random(4)
    line = lambda: rng.choice(["# a", "## b  c", "####", "#x", "", "  ", "\t", "text", " # no"])
    texts = ["\n".join(line() for _ in range(rng.randint(1, 40))) + rng.choice(["", "\n", "\n\n"]) for _ in range(120)] + [None, "", "\n", "# only", "\n\n# x"]
    rows = [(f"p{k % 100}" if k % 7 else "same", t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "path string, content string")
    sections, runs = [], []
    for path, text in rows:
        lines = C.plain_lines(text) if text is not None else []
        starts = [k for k, x in enumerate(lines) if not k or re.match(C.HEADING, x)]
        sections += [(path, n + 1, a + 1, z, "\n".join(lines[a:z])) for n, (a, z) in enumerate(zip(starts, [*starts[1:], len(lines)]))]
        held: list[int] = []
        for k in range(1, len(lines) + 2):
            if k > len(lines) or k % 7 in (3, 4):
                if held:
                    runs.append((path, held[0], held[-1]))
                held = []
            elif lines[k - 1].strip(" "):
                held.append(k)
    found = C.markdown_sections(docs), C.module_runs(docs, lambda i: (i % 7).isin(3, 4))
    assert sorted(tuple(r) for r in found[0].select("path", "section", "start_line", "end_line", "text").collect()) == sorted(sections)
    assert sorted(tuple(r) for r in found[1].select("path", "start_line", "end_line").collect()) == sorted(runs)
    for rows in found:
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
        assert [t for c, t in rows.dtypes if c != "text" and c != "path"] == ["int"] * (len(rows.columns) - 1 - ("text" in rows.columns))
