from nodeloom.__main__ import main


def test_command(spark, tmp_path, capsys):
    (tmp_path / "a.md").write_text("# A\n\ntext\n\n## B\n")
    (tmp_path / "b.html").write_text("<main><h1>H</h1><p>x</p></main>")
    paths = [str(tmp_path / "a.md"), str(tmp_path / "b.html")]
    assert main([".h | to_text", *paths], spark) == 0
    assert capsys.readouterr().out.split() == ["A", "B", "H"]
    assert main(["len", "-A", *paths], spark) == 0
    assert capsys.readouterr().out.split() == ["3", "2"]
    assert main([".h", "-c", *paths], spark) == 0
    assert capsys.readouterr().out.splitlines()[-1] == "total: 3"
    assert main([".h", "--skip", "1", "--limit", "1", "-F", "json", *paths], spark) == 0
    assert capsys.readouterr().out.strip() == '"## B"'
    assert main([".code", "-e", *paths], spark) == 1
    assert main(["1 / 0", "-F", "none", *paths], spark) == 0
    assert "division by zero" in capsys.readouterr().err


def test_formats_updates_and_data(spark, tmp_path, capsys):
    (tmp_path / "a.md").write_text("# One\n\nText **b**.\n")
    (tmp_path / "b.md").write_text("# Two\n")
    (tmp_path / "d.yaml").write_text("a: 1\nb: [x, y]\n")
    (tmp_path / "t.toon").write_text("a: 7\n")
    both = f"{tmp_path}/*.md"

    def out(*arguments):
        code = main([str(x) for x in arguments], spark)
        return code, capsys.readouterr().out.strip()

    assert out(".h1", both, "-F", "html") == (0, "<h1>One</h1>\n<h1>Two</h1>")
    assert out(".h1 | to_text", both, "-F", "yaml")[1].split() == ["One", "Two"]
    assert out(".h1 | to_text", both, "-S", "~~")[1] == "One\n~~\nTwo"
    assert out("filter(fn(n): n.h1;) | len", both, "--eval-all") == (0, "2")
    assert out(".h5", both, "-c", "-e") == (1, "total: 0")
    assert out(".h1 | to_h(to_text(self), 2)", tmp_path / "a.md", "-U") == (0, "## One\n\nText **b**.")
    assert "-# One" in out(".h1 | to_h(to_text(self), 2)", tmp_path / "a.md", "-U", "--diff")[1]
    assert out('get("b") | last', tmp_path / "d.yaml") == (0, "y")
    assert out('get("a") + 1', tmp_path / "t.toon", "-F", "json") == (0, "8")
    assert out(f'read_file("{tmp_path}/b.md") | len', tmp_path / "a.md", "--allow-read", tmp_path / "b.md", "--limit", 1) == (0, "6")
    assert out(".h1", tmp_path / "a.md", "-F", "grep")[1].endswith("a.md:0:# One")
