import subprocess

from verdigris.sources.discovery import Config, context_files, pattern_folders, run_metadata


def test_pattern_folders():
    assert pattern_folders("a/**/b.xml") == ["a/", "a/**/"]
    assert pattern_folders("**/out/x/*.xml") == ["**/out/", "**/out/x/"]
    assert pattern_folders("*.xml") == []


def test_metadata():
    assert run_metadata({"GITHUB_REF_NAME": "main", "GITHUB_HEAD_REF": "dev", "CI_COMMIT_SHA": "c", "GITLAB_CI": "1"}) == {"branch": "dev", "commit_sha": "c", "ci_provider": "gitlab"}


def test_metadata_of_git_itself(tmp_path):
    none = {"branch": None, "commit_sha": None, "ci_provider": None}
    assert run_metadata({}, str(tmp_path)) == none
    git = lambda *args: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b.c", *args], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-b", "trunk")
    git("commit", "--allow-empty", "-m", "first")
    head = git("rev-parse", "HEAD")
    assert run_metadata({}, str(tmp_path)) == none | {"branch": "trunk", "commit_sha": head}
    assert run_metadata({"GITHUB_SHA": "c"}, str(tmp_path)) == none | {"branch": "trunk", "commit_sha": "c"}
    git("checkout", "--detach")
    assert run_metadata({}, str(tmp_path))["branch"] is None


def test_config(tmp_path):
    inner = tmp_path / "a" / "b"
    inner.mkdir(parents=True)
    (tmp_path / "verdigris.toml").write_text('[project]\ntoken = "t"\napi_url = "u"\n[test]\nreport_patterns = ["x"]\n')
    got = Config.resolve(str(inner), {"VERDIGRIS_API_URL": "env"}, token="given")
    assert (got.root, got.token, got.api_url, got.report_patterns) == (str(tmp_path), "given", "env", ("x",))
    (tmp_path / "verdigris.toml").write_text("broken")
    assert Config.resolve(str(inner), {}) == Config(root=str(tmp_path))
    (tmp_path / ".verdigris").mkdir()
    (tmp_path / ".verdigris" / "config.toml").write_text('[project]\ntoken = "first"\n')
    assert Config.resolve(str(inner), {}).token == "first"


def test_context_files(spark, tmp_path):
    for name in ("log.txt", "out/r.xml", "out/trace.txt", "node_modules/x.js", ".gradle/x", "build/y"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    reports = spark.createDataFrame([(f"file:{tmp_path}/out/r.xml",)], "doc string")
    got = context_files(spark, str(tmp_path), "2020-01-01T00:00:00", reports)
    assert [r["path"] for r in got.collect()] == ["build/y", "log.txt", "out/trace.txt"]
