"""Python rules on varied files, with the findings written out by hand."""

from riskloom.operators import pyfacts as pf
from riskloom.operators import pyrules as prl
from riskloom.sources import files as src

FILES = {
    "a.py": ("import base64, os, subprocess as sp\n"
             "x = base64.b64decode('eA').decode()\nos.system(x)\nx = 'safe'\nos.system(x)\n"
             "y: str = 'rm ' + input()\nsubprocess.Popen(y)\nsubprocess.run(args='echo ' + argv[1])\n"
             "eval(exec('a') + 'b')\nexec(codecs.decode(s, 'rot13'))\neval(f())\n"),
    "b.py": ("class Gate:\n    def check(self, password):\n        if password == 'hunter2' or self.api_key != 'k':\n"
             "            return True\n        elif user_token in ('a', 'b'):\n            return False\n"
             "if not (x.secret_key == 'z'):\n    pass\nif 'x' == other:\n    pass\n"),
    "c.py": ("import joblib, pickle, torch\nDEFAULT = 'weights.pt'\n\n@cache(joblib.load('z.pkl'))\n"
             "def load(path, *rest, **kw):\n    joblib.load(DEFAULT)\n    joblib.load(path)\n    joblib.load(rest)\n"
             "    joblib.load(filename='notes.md')\n    joblib.load(os.path.join(a, b))\n"
             "    torch.load(path, weights_only=False)\n    torch.load(path, weights_only=True)\n"
             "    pickle.loads(data)\n    DEFAULT = 'x.txt'\n    joblib.load(DEFAULT)\n    joblib.load()\n"
             "lambda q: torch.load(q)\n"),
    "d.py": ("import os\n\ndef ask(question, history):\n    p = 'Q: ' + question\n    p = 'fixed'\n"
             "    r1 = client.chat.completions.create(messages=p)\n    q2 = question\n    q2 = escape_html(q2)\n"
             "    model.generate(q2)\n    m = {'role': 'user', 'content': history}\n"
             "    anthropic.messages.create(messages=[m])\n    env = os.getenv('X')\n"
             "    llm.chat(prompt=env, temperature=question)\n    genai.GenerativeModel('m').generate_content(req.body)\n"
             "    def inner():\n        return openai.chat.completions.create(messages=question)\n"
             "    a = b = question\n    client.messages.create(content=b)\n"
             "top = request.args['q']\nllm.complete(top)\nllm.complete(request.json)\n"),
    "e.py": "def broken(:\n",
}

# (file, rule, line), read off the files above
EXPECTED = {
    ("a.py", "shell decoded", 3),        # x is decoded on line 2
    ("a.py", "shell decoded", 5),        # a plain string does not replace the tracked value
    ("a.py", "shell external", 7), ("a.py", "shell external", 8),
    ("a.py", "exec concat", 9), ("a.py", "exec decoded", 10),
    ("b.py", "auth", 3), ("b.py", "auth", 7),
    ("c.py", "joblib", 6), ("c.py", "joblib", 7), ("c.py", "joblib", 8), ("c.py", "joblib", 10),
    ("c.py", "torch", 11), ("c.py", "torch", 17), ("c.py", "pickle", 13),
    ("d.py", "prompt", 11), ("d.py", "prompt", 13), ("d.py", "prompt", 14), ("d.py", "prompt", 18), ("d.py", "prompt", 21),
}


def found(facts):
    out = set()
    for r in prl.py_dynamic_exec(facts).collect():
        out.add((r.file_path, "exec decoded" if r.severity == "critical" else "exec concat", r.line_start))
    for r in prl.py_shell_exec(facts).collect():
        out.add((r.file_path, "shell decoded" if r.severity == "critical" else "shell external", r.line_start))
    rules = {"auth": prl.py_auth_bypass, "pickle": prl.model_pickle, "torch": prl.model_torch, "joblib": prl.model_joblib,
             "prompt": prl.py_prompt_injection}
    for name, rule in rules.items():
        out |= {(r.file_path, name, r.line_start) for r in rule(facts).collect()}
    return out


def test_findings_by_hand(spark, make_files):
    facts = pf.py_facts(src.eligible_files(make_files({"bf": FILES}))).cache()
    assert found(facts) == EXPECTED


def test_hostile_files_do_not_stop_the_others(spark, make_files):
    deep = "x = " + " + ".join(["a"] * 3000) + "\n"
    deeper = "x = " + " + ".join(["a"] * 50_000) + "\n"
    nested = "x = " + "(" * 500 + ")" * 500 + "\n"
    files = make_files({"h": {"deep.py": deep, "deeper.py": deeper, "nested.py": nested, "nul.py": "x = 1\n", "ok.py": "eval('a' + 'b')\n"}})
    facts = pf.py_facts(src.eligible_files(files)).cache()
    assert [(r.file_path, r.line_start) for r in prl.py_dynamic_exec(facts).collect()] == [("ok.py", 1)]
    bad = {r.file_path for r in prl.parse_errors(facts).collect()}
    known = {r.file_path for r in facts.where("kind = 'assign'").collect()}
    assert {"deep.py", "deeper.py", "nested.py", "nul.py"} <= bad | known and "ok.py" not in bad


def test_many_assignments_and_uses_stay_linear(spark, make_files):
    text = "import os\n" + "c = base64.b64decode(x)\nos.system(c)\n" * 1500
    facts = pf.py_facts(src.eligible_files(make_files({"m": {"a.py": text}})))
    assert prl.py_shell_exec(facts).count() == 1500
