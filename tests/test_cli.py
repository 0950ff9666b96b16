"""The command line: generate records, run views in batch and stream."""

import json
import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _cli(*args):
    out = subprocess.run([sys.executable, "-m", "tidemark", "--master", "local[2]",
                          "--partitions", "2", *args], cwd=REPO, capture_output=True,
                         text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout


def test_generate_and_run(tmpdir_path):
    _cli("generate", "--minutes", "1", "--out", tmpdir_path + "/edr")
    flows, sessions = tmpdir_path + "/edr/flows", tmpdir_path + "/edr/sessions"
    batch = json.loads(_cli("run", "t_sort", "--flows", flows, "--sessions", sessions,
                            "--out", tmpdir_path + "/t").splitlines()[-1])
    assert batch["input_rows"] > 60000
    stream = json.loads(_cli("run", "projection_view", "--flows", flows, "--stream",
                             "--out", tmpdir_path + "/p").splitlines()[-1])
    assert stream["mode"] == "stream"
    n_csv = sum(max(0, sum(1 for _ in open(os.path.join(tmpdir_path, "p", f))) - 1)
                for f in os.listdir(tmpdir_path + "/p") if f.endswith(".csv"))
    assert n_csv == stream["input_rows"]        # every row out, input folders untouched
    assert not [f for f in os.listdir(flows) if "flush" in f]


def test_stream_over_int_keys(tmpdir_path):
    """The end-of-input record has a key that is valid as INT too."""
    _cli("generate", "--minutes", "1", "--out", tmpdir_path + "/edr")
    flows = tmpdir_path + "/edr/flows"
    before = sorted(os.listdir(flows))
    out = json.loads(_cli("run", "flows_agg_step_1", "--flows", flows, "--stream").splitlines()[-1])
    assert out["mode"] == "stream" and sorted(os.listdir(flows)) == before
