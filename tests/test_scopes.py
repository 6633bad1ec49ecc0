"""The declaration scanner on sources that lines alone don't show rightly."""

import pytest

from siltloom.operators import entities
from siltloom.operators.scopes import lex, scan_source


def found(source, language):
    return [(e["type"], e["name"], e["start_line"], e["end_line"]) for e in scan_source(source, language)]


def related(source, language, name):
    return [f"{r['type']} {r['target_name']}" for e in scan_source(source, language) if e["name"] == name for r in e["relations"]]


def test_java_base_on_the_next_line():
    assert related("class A\n  extends q.B<C>\n  implements D,\n   E {\n}", "java", "A") == ["EXTENDS B", "IMPLEMENTS D", "IMPLEMENTS E"]


def test_java_parameters_over_two_lines():
    source = "class A {\n  void f(int a,\n    int b)\n  {\n    call(a);\n    z();\n  }\n}"
    assert found(source, "java") == [("Class", "A", 1, 8), ("Method", "f", 2, 7)]
    assert related(source, "java", "f") == ["CALLS call", "CALLS z"]


def test_java_annotation_on_the_line():
    e = scan_source('class A {\n  /** Says. */\n  @Override @Named("x") public String toString() { return s(); }\n}', "java")[1]
    assert (e["name"], e["annotations"], e["signature"], e["docstring"]) == ("toString", ["Override", "Named"], "public String toString()", "Says. */")


def test_java_braces_in_comments_strings_and_text_blocks():
    source = 'class A {\n  /* { */ // {\n  String s = "{", t = """\n    class No { void no() {}\n  """; char c = \'{\';\n  void f() {}\n}\nclass B {}'
    assert found(source, "java") == [("Class", "A", 1, 7), ("Field", "s", 3, 5), ("Field", "t", 3, 5), ("Field", "c", 5, 5), ("Method", "f", 6, 6), ("Class", "B", 8, 8)]


def test_java_initialisers_hold_no_members():
    source = "class A {\n  Runnable r = new Runnable() { public void run() { go(); } };\n  static { boot(); }\n  Map<String, List<int[]>> m = x(), n;\n  int a[] = {1}, b;\n  void f() { class L { void g() {} } }\n}"
    assert [(k, n) for k, n, *_ in found(source, "java")] == [("Class", "A"), ("Field", "r"), ("Field", "m"), ("Field", "n"), ("Field", "a"), ("Field", "b"), ("Method", "f"), ("Class", "L"), ("Method", "g")]


def test_java_enums_records_and_annotation_types():
    source = "enum E {\n  @Old ONE(1) { void q() {} },\n  TWO;\n  int n;\n}\nrecord P(int x) implements Q { int y() { return x; } }\n@interface N { int v() default 1; }\nclass Z { @interface N { int v(); } }"
    assert [(k, n) for k, n, *_ in found(source, "java")] == [("Enum", "E"), ("Field", "ONE"), ("Field", "TWO"), ("Field", "n"), ("Class", "P"), ("Method", "y"), ("Class", "Z")]
    assert related(source, "java", "P") == ["IMPLEMENTS Q", "HAS_METHOD y"]


def test_python_strings_and_nesting():
    source = 'T = """\ndef no(): pass\n"""\nclass A(B,\n        metaclass=M):\n    s = "class No:"\n    def f(self):\n        def inner(): pass\n        class Deep: pass\n    class In:\n        def g(self): return h(\n1)\ndef top(): pass\n'
    assert found(source, "python") == [("Class", "A", 4, 12), ("Field", "s", 6, 6), ("Method", "f", 7, 9), ("Class", "Deep", 9, 9), ("Class", "In", 10, 12), ("Method", "g", 11, 12), ("Function", "top", 13, 13)]


def test_script_braces_below_and_templates():
    source = "class A\n{\n  run(x)\n  {\n    call(`a ${b(`}`)} {`);\n  }\n  y = 1\n  static async *z() { return /[}]/.test(q()) }\n}\nconst f = async (x) => {\n  g(x)\n}\n"
    assert found(source, "javascript") == [("Class", "A", 1, 9), ("Method", "run", 3, 6), ("Method", "z", 8, 8), ("Function", "f", 10, 12)]
    assert related(source, "javascript", "run") == ["CALLS call", "CALLS b"]


def test_typescript_types():
    source = "abstract class A<T> extends B<T> {\n  abstract no(): void;\n  f(x: T): { a: number } { return g(x); }\n}\nfunction k<T>(x: T): Promise<{ a: T }> { return l(x); }\nexport const h = (x: number): void => { m(x); };"
    assert [(k, n) for k, n, *_ in found(source, "typescript")] == [("Class", "A"), ("Method", "f"), ("Function", "k"), ("Function", "h")]


def test_go_groups():
    source = "type (\n  A struct { x int }\n  B interface {\n    Get(x int) (int,\n      error)\n    fmt.Stringer\n  }\n  C = int\n)\nfunc (s *A) M(\n  x int,\n) int {\n  h(`}`)\n}\ntype D []string"
    assert found(source, "go") == [("Struct", "A", 2, 2), ("Interface", "B", 3, 7), ("Method", "Get", 4, 5), ("Method", "M", 10, 14), ("Struct", "D", 15, 15)]


@pytest.mark.parametrize("language", ["python", "java", "javascript", "typescript", "go"])
def test_broken_sources_end(language):
    words = ["class A", "{", "}", "(", ")", "def f", "function", "func", "type", "enum E", "record R", "@", "<", "`", "${", '"', "'", "=", "=>", "extends", ":", ";", "\n", "/", "#", "x", ","]
    for i, a in enumerate(words):
        for b in words:
            for c in words[i % 3 :: 3]:
                scan_source(f"{a} {b} {c}", language)
    assert lex("", language) == [] and scan_source("", language) == []


def test_rejects_come_from_the_same_pass(spark, monkeypatch):
    files = spark.createDataFrame([("r", "b", "a.py", "def f(): pass"), ("r", "b", "c.txt", "def f(): pass"), ("r", "b", "d.py", None)], "repo string, branch string, file_path string, content string")
    assert [(r.type, r.name, r.error) for r in entities.scan_files(files).collect()] == [("Function", "f", None)]
    scanned = spark.createDataFrame([("r", "b", "a.py", None), ("r", "b", "b.py", "ValueError: no")], "repo string, branch string, file_path string, error string")
    assert [tuple(r) for r in entities.rejects_of(scanned).collect()] == [("r", "b", "b.py", "ValueError: no")]
    assert entities.entities_of(scanned).columns == ["repo", "branch", "file_path"]


def test_equal_texts_are_scanned_once(spark):
    text = "class A(B):\n    def f(self): g()\n"
    rows = [("r", b, p, c) for b in ("main", "dev") for p, c in (("a.py", text), ("copy.py", text), ("a.js", text), ("n.py", None), ("e.py", ""), ("x.txt", text))]
    files = spark.createDataFrame(rows, "repo string, branch string, file_path string, content string")
    by = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    assert by(entities.scan_once(files)) == by(entities.scan_files(files))
