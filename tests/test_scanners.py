import pytest

from sparkledger.sources import scanners as S
from sparkledger.sources import tables


def rows(found):
    return [(f.fqcn, f.method, f.begin_line, f.end_line, f.tags, f.display_name) for f in found]


JAVA = '''package com.acme;
import org.junit.jupiter.api.*;

public class OrderTest {
    // @Test void commented() {}
    @Test
    @Tag("fast") @Tag("crypto")
    @DisplayName("it's \\"quoted\\"")
    void alpha() {
        String s = "} @Test void no() {";
    }

    @ParameterizedTest
    @Tags({@Tag("a"), @Tag(value = "b")})
    public void beta(int x) { }

    void helper() { }

    @Nested
    class Inner {
        @org.junit.jupiter.api.Test
        void gamma() { }
    }
}
'''


def test_java():
    got = rows(S.scan_java(JAVA))
    assert got == [
        ("com.acme.OrderTest", "alpha", 6, 11, ["fast", "crypto"], 'it\'s "quoted"'),
        ("com.acme.OrderTest", "beta", 13, 15, ["a", "b"], None),
        ("com.acme.OrderTest", "gamma", 21, 22, [], None),
        ("com.acme.Inner", "gamma", 21, 22, [], None),
    ]


def test_java_markers_follow_imports():
    old = "import org.junit.Test;\nclass A { @Theory public void t() {} @DisplayName(\"\") @Test void u() throws X {} }"
    assert [(m, d) for _, m, _, _, _, d in rows(S.scan_java(old))] == [("t", None), ("u", "")]
    assert rows(S.scan_java("class A { @Theory void t() {} }")) == []
    assert len(rows(S.scan_java("class A { @Check void t() {} }", markers=frozenset(("Check",))))) == 1
    with pytest.raises(S.SourceError):
        list(S.scan_java("class A { "))


CS = '''namespace Shop.Tests
{
    using Xunit;

    public class Cart
    {
        [Fact(DisplayName = "adds \\"one\\"")]
        [Trait("Category", "fast"), Trait("Owner", "x")]
        public void Adds()
        {
            var s = "}";
        }

        [Theory]
        [InlineData(1, "a")]
        public async Task<int> Sums<T>(int a, string b) => await F(a);

        public void Helper() { }

        public class Nested { [Fact] public void Deep() { } }
    }
}
'''


def test_csharp():
    assert rows(S.scan_csharp(CS)) == [
        ("Shop.Tests.Cart", "Adds", 7, 12, ["fast"], 'adds "one"'),
        ("Shop.Tests.Cart", "Sums", 14, 16, [], None),
        ("Shop.Tests.Cart.Nested", "Deep", 20, 20, [], None),
    ]
    nunit = "using NUnit.Framework;\nnamespace A.B;\nclass C {\n [Test, Category(\"slow\")]\n public void T() {}\n [Fact] public void F() {}\n}"
    assert rows(S.scan_csharp(nunit)) == [("A.B.C", "T", 4, 5, ["slow"], None)]
    ms = "using Microsoft.VisualStudio.TestTools.UnitTesting;\nclass C { [TestMethod] [TestCategory(\"x\")] public void T() {} }"
    assert rows(S.scan_csharp(ms)) == [("C", "T", 2, 2, ["x"], None)]


TS = '''import { describe, it } from 'x';
describe('Auth', () => {
  it('logs in', () => { expect("it('no')").toBe(1); });
  describe(`nested`, function () {
    test.each([[1, 2]])('adds %i', (a, b) => {
      expect(a).toBe(b);
    });
    it.skip("it's off", () => {});
  });
});
test(`value ${x} ok`, async () => {
});
it.each`
 a
`('table', () => {});
obj.test('no');
'''


def test_typescript():
    assert rows(S.scan_typescript(TS, "src/auth.test.ts")) == [
        ("auth.test", "Auth > logs in", 3, 3, [], None),
        ("auth.test", "Auth > nested > adds %i", 5, 7, [], None),
        ("auth.test", "Auth > nested > it's off", 8, 8, [], None),
        ("auth.test", "value ${...} ok", 11, 12, [], None),
        ("auth.test", "table", 13, 15, [], None),
    ]


def test_go():
    go = "package auth\n\nfunc TestA(t *testing.T) {\n\tx := \"}\"\n}\nfunc Test1(t *testing.T) {}\nfunc Test_b(t *testing.T) {}\nfunc Test(t *testing.T) {}\nfunc TestM(m *testing.M) {}\nfunc (s *S) TestMethod(t *testing.T) {}\nfunc helper() {}\n"
    assert rows(S.scan_go(go)) == [("auth", "TestA", 3, 5, [], None), ("auth", "Test_b", 7, 7, [], None), ("auth", "Test", 8, 8, [], None)]
    assert rows(S.scan_go("func TestA(t *testing.T) {}", "a/b/x_test.go"))[0][0] == "a.b"


def test_python():
    py = "import pytest\n\n@pytest.mark.slow\n@pytest.mark.parametrize('a', [1])\ndef test_top(a):\n    pass\n\nclass TestX:\n    async def test_m(self):\n        pass\n    def helper(self): pass\n    class TestInner:\n        def test_no(self): pass\n\nclass Other:\n    def test_no(self): pass\n"
    assert rows(S.scan_python(py, "pkg/test_x.py")) == [("pkg.test_x", "test_top", 5, 6, ["slow"], None), ("pkg.test_x.TestX", "test_m", 9, 10, [], None)]
    with pytest.raises(S.SourceError):
        list(S.scan_python("def ("))
    assert S.is_python_test("test_a.py") and S.is_python_test("a_test.py") and not S.is_python_test("testa.py")


def test_powershell():
    ps = 'Describe "M" -Tag "security" {\n  # It "no" {}\n  It "accepts" {\n    $x = "}"\n  }\n  it \'it\'\'s\' -Tag "a", "b" {\n  }\n}\n'
    assert rows(S.scan_powershell(ps, "Auth.Tests.ps1")) == [("Auth", "accepts", 3, 5, [], None), ("Auth", "it's", 6, 7, ["a", "b"], None)]


def test_abap_and_scripts():
    abap = "CLASS lcl_a DEFINITION\n  FOR TESTING.\n  PRIVATE SECTION.\n    METHODS: setup,\n      one FOR TESTING,\n      two FOR TESTING RAISING cx.\nENDCLASS.\nCLASS lcl_b DEFINITION.\n  METHODS one FOR TESTING.\nENDCLASS.\nCLASS lcl_a IMPLEMENTATION.\n  METHOD setup.\n  ENDMETHOD.\n  METHOD one. \" METHOD two.\n    x = 'METHOD two.'.\n  ENDMETHOD.\n  METHOD two.\n  ENDMETHOD.\nENDCLASS.\nCLASS lcl_b IMPLEMENTATION.\n  METHOD one.\n  ENDMETHOD.\nENDCLASS.\n"
    assert rows(S.scan_abap(abap)) == [("LCL_A", "ONE", 14, 16, [], None), ("LCL_A", "TWO", 17, 18, [], None)]
    ecl = "ATTRIBUTES\n\nFUNCTION Z_A\n  DO\n  DONE\n\nFUNCTION Z_B\n  DO\n"
    assert rows(S.scan_ecatt(ecl)) == [("Z_A", "Z_A", 3, 5, [], None), ("Z_B", "Z_B", 7, 8, [], None)]


def test_cobol():
    cbl = "       PROCEDURE DIVISION.\n       MFU-TC-one.\n           STOP RUN.\n\n       MFU-TC-TWO.\n           STOP RUN.\n"
    assert rows(S.scan_cobol(cbl, "x/auth.cbl")) == [("auth", "MFU-TC-ONE", 2, 4, [], None), ("auth", "MFU-TC-TWO", 5, 6, [], None)]
    cut = "TestSuite 'S'\n\nTestCase 'it''s'\n  Expect\nTestCase \"b\"\n"
    assert rows(S.scan_cobol(cut, "a.cut")) == [("a", "it's", 3, 4, [], None), ("a", "b", 5, 5, [], None)]


def test_tree(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/OrderTest.java").write_text(JAVA)
    (tmp_path / "a/b/test_x.py").write_text("def test_a():\n    pass\n")
    (tmp_path / "a/b/bad_test.py").write_text("def (")
    (tmp_path / "a/readme.txt").write_text("@Test")
    files = tables.read_files(spark, str(tmp_path), [".java", ".py"])
    got = S.scan_tree(files, str(tmp_path)).cache()
    assert S.had_errors(got)
    assert sorted((r.plugin, r.method, r.loc, r.file_stem) for r in got.where("method is not null").collect()) == [("java", "alpha", 6, "a.OrderTest"), ("java", "beta", 3, "a.OrderTest"), ("java", "gamma", 2, "a.OrderTest"), ("java", "gamma", 2, "a.OrderTest"), ("python", "test_a", 2, "a.b.test_x")]
    assert S.scan_tree(files, str(tmp_path), enabled=["python"]).where("method is not null").count() == 1
    assert S.scan_tree(files, str(tmp_path), suffixes=["java:Test.java"], enabled=["java"]).count() == 4
    assert {r.fqcn: len(r.content_hash) for r in S.class_sources(got, files).collect()} == {"com.acme.OrderTest": 64, "com.acme.Inner": 64, "a.b.test_x": 64}
    with pytest.raises(ValueError):
        S.register("java", (".x",), S.scan_java)
