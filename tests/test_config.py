from codeloom.sources import config, ignore


def test_layers_in_order():
    project = config.Layer("project", text="!build/\nlogs/\n", entries=("old",))
    assert project.shadowed == ("old",)
    rules = config.effective(config.Layer("global", entries=("tmp",)), project)
    assert [r.negated for r in rules if r.regex.endswith("build$")] == [False, True]
    assert len(rules) == len(config.DEFAULT_DIRECTORIES) + 3


def test_patterns_are_added_and_removed():
    text, new, old = config.added("a\n", ["a", "b/", "b/"])
    assert (text, new, old) == ("a\nb/\n", ["b/"], ["a", "b/"])
    text, done = config.removed(text, ["a", "dist", "zzz"], config.builtin().rules)
    assert text == "b/\n!dist\n" and done == {"removed": ["a"], "negated": ["!dist"], "not_present": ["zzz"]}


def test_presets_by_markers(spark):
    paths = ["package.json", "app/go.mod", "deep/er/Cargo.toml", "ProjectSettings/ProjectVersion.txt", "x/notes.ipynb", "xpom.xml"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    assert config.detected(files) == ["node", "go", "unity", "ml"]
    assert ignore.compile_rules("")[0] == []
