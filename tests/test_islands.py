import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from loopgauge.sources import islands
from loopgauge.sources import python_blocks as pb

CODE = {
    "javascript": """import x from 'y';
// function no() {}
export default function main(a, b = dflt, {c, d}) {
  const s = `tpl ${a.map(z => { for (const q of z) { q.go(); } return `in ${z}`; })} function fake() {`;
  for (let i = 0; i < a.length; i++)
    for (const k in b) helper(i, k)
  const re = /[/"'{]+/g.test(s);
  if (a) { b(); } else if (c) { d?.(1); } else d()
  function inner() { while (true) { break } }
  do { step() } while (cond(a))
  return obj.one.two(a)
}
const f = function named() {};
const o = { meth(x) { return x }, async *gen() { yield 1 }, k: (y) => { go(y) } };
class A extends mixin(B) {
  static create() { return new A() }
  constructor(x) { super(x); this.run(x) }
  get v() { return this.#p }
}
""",
    "typescript": """interface Shape<T> { area(): number; name: string }
abstract class Base<T extends object> implements Shape<T> {
  private items: Array<{a: number}> = [];
  constructor(private readonly x: number, y?: string) { super(); }
  public async find<K>(key: K, opts: {deep: boolean} = {deep: false}): Promise<{r: K}> { for await (const z of this.items) { await this.look(z); } return {r: key}; }
  abstract nope(): void;
}
export function over(a: string): void;
export function over(a: any): void { if (a) { return; } }
""",
    "java": '''package a.b;
/** doc { */
@Service
public class Foo<T> extends Bar implements Baz {
    private static final Map<String, List<Integer>> M = new HashMap<>();
    static { init(); }
    public Foo(int a, String... rest) throws IOException { super(a); this.go(a); }
    @Override
    public <K> List<K> find(final Map<String, K> m, int[] xs) {
        for (String s : m.keySet()) {
            while (s != null) { s = next(s); }
        }
        xs.stream().map(x -> x * 2).filter((a, b) -> { return check(a, b); });
        Runnable r = new Runnable() { public void run() { act(); } };
        do { tick(); } while (more());
        try { risky(); } catch (Exception e) { log(e); } finally { done(); }
        String t = """
           class Fake { void x() {} }
           """;
        char c = '{';
        return null;
    }
    abstract void later(int q);
    enum Color { RED { void paint() { red(); } }; Color() { reg(); } }
    interface In { void sig(String a); default int d() { return 1; } }
}
''',
    "c": """#include <stdio.h>
#define LOOP(x) for (x) {
static int add(int a, const char *b[]) {
    for (int i = 0; i < 10; ++i) { if (i) foo(i); else bar(); }
    while (x) y();
    return s->fn(a) + "}" [0];
}
struct P { int x; };
int table[] = { 1, 2 };
void proto(int a);
int main(void)
{
    switch (a) { case 1: go(); }
    return 0;
}
""",
    "cpp": """namespace n { namespace m {
template <class T, typename U>
class EXPORT Box final : public Base<T>, private Other {
public:
    Box(int a) : Base<T>(a), x_{a} { init(); }
    virtual ~Box() {}
    int size() const noexcept override { return v.size(); }
    T operator()(const T& a, T b = T{}) { return ns::call(a); }
    void later();
};
template <typename T> auto Box<T>::later(int q) -> int { for (auto& e : v) { std::sort(e.begin(), e.end(), [&](int a, int b) { return a < b; }); } return 0; }
}}
auto raw = R"x( class No { )x";
enum class E { A };
static void g(std::map<int, int> m, int n) { int a[3] = {1,2,3}; a[0] = h(n); }
""",
    "go": """package main
type I interface { M(x int) string }
func (s *S) Run(ctx context.Context, a, b int) (out map[string]struct{}, err error) {
    for i := range xs { for { if x { break }; s.step(i) } }
    go func(q int) { work(q) }(1)
    raw := `func no() { "`
    return nil, fmt.Errorf("x %d", 'a')
}
func Map[T any, U any](xs []T, f func(T) U) []U { for _, x := range xs { out = append(out, f(x)) }; return out }
func main() { if err := run(); err != nil { panic(err) } }
""",
    "rust": """/* a /* nested */ fn no() {} */
impl<'a, T: Clone> Tr<'a> for Foo<T> where T: Fn(i32) -> i32 {
    #[inline(always)]
    pub(crate) async fn run<'b>(&'b mut self, x: Vec<T>, mut y: u8) -> Result<(), Box<dyn E>> where T: X {
        for a in x.iter() { while let Some(b) = it.next() { loop { break; } } }
        let c = '{'; let s = r#"fn z() { " "#;
        let v = Vec::<u8>::with_capacity(3);
        match y { 1 => go(), _ => {} }
        fn inner(q: i32) -> i32 { q }
    }
}
trait T2 { fn sig(&self); fn dflt(&self) { self.sig() } }
unsafe extern "C" fn ext(a: *const u8) {}
""",
    "csharp": """namespace N {
  public class Foo : Bar {
    public int X { get; set; }
    public Foo(int a) : base(a) { Init(); }
    public async Task<int> Go<T>(List<T> xs, string s = "a{") where T : class { foreach (var x in xs) { await Do(x); } var q = xs.Select(x => x.Y); return 1; }
    int Sq(int v) => v * v;
    string p = @"c:\\{";
  }
  interface I { void M(int a); }
}
""",
}
#: kind, qualified name, parameters, deepest loop, calls
WANT = {
    "javascript": [
        ("function", "main", "a b", 2, "map go helper test b d step cond two"), ("function", "main.inner", "", 1, ""), ("method", "meth", "x", 0, ""), ("method", "gen", "", 0, ""),
        ("class", "A", "", 0, "mixin run"), ("method", "A.create", "", 0, ""), ("method", "A.constructor", "x", 0, "run"), ("method", "A.v", "", 0, ""),
    ],
    "typescript": [("class", "Shape", "", 0, ""), ("class", "Base", "", 1, "look"), ("method", "Base.constructor", "x y", 0, ""), ("method", "Base.find", "key opts", 1, "look"), ("function", "over", "a", 0, "")],
    "java": [
        ("class", "Foo", "", 2, "init go keySet next stream map filter check act tick more risky log done red reg"), ("constructor", "Foo.Foo", "a rest", 0, "go"),
        ("method", "Foo.find", "m xs", 2, "keySet next stream map filter check act tick more risky log done"), ("lambda", "Foo.find.x -> x * 2", "x", 0, ""),
        ("lambda", "Foo.find.(a, b) -> { return check(a, b); }", "a b", 0, "check"), ("method", "Foo.find.run", "", 0, "act"), ("method", "Foo.later", "q", 0, ""), ("method", "Foo.paint", "", 0, "red"),
        ("constructor", "Foo.Color", "", 0, "reg"), ("class", "In", "", 0, ""), ("method", "In.sig", "a", 0, ""), ("method", "In.d", "", 0, ""),
    ],
    "c": [("function", "add", "a b", 1, "foo bar y fn"), ("function", "main", "", 0, "go")],
    "cpp": [
        ("class", "Box", "", 0, "init size call"), ("method", "Box.Box", "a", 0, "init"), ("method", "Box.~Box", "", 0, ""), ("method", "Box.size", "", 0, "size"), ("method", "Box.operator()", "a b", 0, "call"),
        ("function", "later", "q", 1, "begin end"), ("lambda", "later.[&](int a, int b) { return a < b; }", "a b", 0, ""), ("function", "g", "m n", 0, "h"),
    ],
    "go": [("method", "Run", "ctx a b", 2, "step work Errorf"), ("function", "Map", "xs f", 1, "f"), ("function", "main", "", 0, "run panic")],
    "rust": [("function", "run", "x y", 3, "iter Some next with_capacity go"), ("function", "run.inner", "q", 0, ""), ("function", "dflt", "", 0, "sig"), ("function", "ext", "a", 0, "")],
    "csharp": [
        ("class", "Foo", "", 1, "Init Do Select"), ("constructor", "Foo.Foo", "a", 0, "Init"), ("method", "Foo.Go", "xs s", 1, "Do Select"), ("lambda", "Foo.Go.x => x.Y", "x", 0, ""), ("method", "Foo.Sq", "v", 0, ""),
        ("class", "I", "", 0, ""), ("method", "I.M", "a", 0, ""),
    ],
}


@pytest.mark.parametrize("language", list(CODE))
def test_blocks(language):
    got = islands.blocks(language, "f", CODE[language])
    assert [(b["kind"], b["qualified_name"], " ".join(b["parameters"]), b["max_loop_depth"], " ".join(b["calls"])) for b in got] == WANT[language]
    assert not any(b["error_state"] for b in got)
    for b in got:
        assert CODE[language].encode()[b["start_byte"] : b["end_byte"]].decode() == b["source"] and b["source"].startswith(b["signature"].split("\n")[0])


def test_places_loops_and_branches():
    main, inner = islands.blocks("javascript", "f", CODE["javascript"])[:2]
    assert (main["start_line"], main["end_line"], inner["parent_id"]) == (3, 12, main["stable_id"])
    assert [(x["kind"], x["nesting_depth"], x["parent_loop_index"], x["start_line"], x["end_line"]) for x in main["loops"]] == [
        ("for", 1, None, 4, 4), ("for", 1, None, 5, 6), ("for", 2, 1, 6, 6), ("while", 1, None, 9, 9), ("while", 1, None, 10, 10)]
    assert [x["kind"] for x in main["branches"]] == ["if", "else", "if", "else"] and main["signature"] == "function main(a, b = dflt, {c, d})"
    calls = {c["call_name"]: c for c in main["call_sites"]}
    assert calls["two"]["receiver"] == "obj.one" and calls["helper"]["inside_loop_depth"] == 2 and calls["go"]["inside_loop_depth"] == 1 and calls["cond"]["inside_loop_depth"] == 1
    (loop,) = islands.blocks("java", "f", "class A { void f() { while (lo < hi) { int mid = lo + hi; } } }")[1]["loops"]
    assert loop["bound_hint"] == "logarithmic" and loop["estimated_complexity"] == "O(log n)"


def test_damage_stays_in_its_block():
    code = "function a() { for (;;) { x(; } }\nfunction b() { y(']'); }\nfunction c() { z('open); }\nfunction d() { w(); }\n"
    got = {b["name"]: b for b in islands.blocks("javascript", "f", code)}
    assert set(got) == set("abcd") and [got[k]["error_state"] for k in "abcd"] == [True, False, True, False]


@pytest.mark.parametrize("language", list(islands.LANGUAGES))
def test_any_damage_gives_blocks(language):
    rng = random.Random(language)
    for _ in range(60):
        text = list(CODE.get(language, CODE["typescript"]))
        for _ in range(rng.randint(1, 12)):
            at = rng.randrange(len(text))
            if rng.random() < 0.5:
                del text[at : at + rng.randint(1, 9)]
            else:
                text[at:at] = rng.choice("{}()[];\"'`<>/*:=é\n")
        text = "".join(text)
        for b in islands.blocks(language, "f", text):
            assert text.encode()[b["start_byte"] : b["end_byte"]].decode() == b["source"] and b["loop_count"] == len(b["loops"])


@given(st.sampled_from(list(islands.LANGUAGES)), st.text(alphabet="fn(){}[];:=<>\"'`/\\*#@ forwhiledoclass\n\t$é", max_size=120))
def test_any_text_gives_blocks(language, text):
    for b in islands.blocks(language, "f", text):
        assert text.encode()[b["start_byte"] : b["end_byte"]].decode() == b["source"]


def test_depth_has_no_limit():
    assert len(islands.blocks("javascript", "f", "function f() {" + "[" * 20_000 + "]" * 20_000 + "}")) == 1
    chain = "function f() {" + "if (a) { b(); } else " * 3000 + "c(); }"
    assert len(islands.blocks("javascript", "f", chain)[0]["branches"]) == 6000


def test_extraction_on_spark(spark):
    rows = [(f"x.{k}", k, v) for k, v in CODE.items()] + [("n.js", "javascript", None), ("t.rb", "ruby", "def x; end")]
    got = pb.extract(spark.createDataFrame(rows, "file_path string, language string, content string")).groupBy("language").count().collect()
    assert {r.language: r["count"] for r in got} == {k: len(v) for k, v in WANT.items()}
