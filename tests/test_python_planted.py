"""Python rules on generated programs: what each must flag is known from how it was put together."""

import random

from riskloom.operators import pyfacts as pf
from riskloom.operators import pyrules as prl
from riskloom.sources.files import eligible_files

EXEC, AUTH, MODEL, PROMPT = "obfuscated_dynamic_execution", "hardcoded_auth_bypass", "unsafe_model_deserialization", "prompt_injection_risk"


def dynamic(rng, i):
    """Bare eval or exec of a concatenation or a decoded value."""
    f = rng.choice(["eval", "exec"])
    arg, bad = rng.choice([('"a" + x', True), ('base64.b64decode(x)', True), ('bytes.fromhex("61")', True), ("x", False), ('"a"', False), ('"%s" % x', False)])
    owner = rng.choice(["", "", "tool."])
    return [f"{owner}{f}({arg})"], [(0, EXEC)] if bad and not owner else []


def shell(rng, i):
    """Shell calls of decoded or external data, at once or by name."""
    value, bad = rng.choice([(f'base64.b64decode("x{i}").decode()', True), ('"echo " + request.args.get("c")', True), ('"ls " + folder', False), ('"ls"', False)])
    call = rng.choice(["os.system({})", "subprocess.run({}, shell=True)", "subprocess.call({})"])
    if rng.random() < 0.5:
        return [f"cmd{i} = {value}", "pass", call.format(f"cmd{i}")], [(2, EXEC)] if bad else []
    return [call.format(value)], [(0, EXEC)] if bad else []


def auth(rng, i):
    """A secret-like name compared with a fixed text."""
    name, op, value, bad = rng.choice([("token", "==", '"let me in"', True), ("user.password", "==", '"hunter2"', True), ("admin_key", "==", '"k"', True),
                                       ("color", "==", '"red"', False), ("token", "==", "expected", False), ("token", "==", "3", False)])
    return [f"if {name} {op} {value}:", "    pass"], [(0, AUTH)] if bad else []


def model(rng, i):
    """Unsafe loaders."""
    call, bad = rng.choice([("pickle.loads(data)", True), ("pickle.load(f)", True), ("torch.load(p)", True), ("torch.load(p, weights_only=False)", True),
                            ("torch.load(p, weights_only=True)", False), ('joblib.load("m.joblib")', True), ('joblib.load("notes.txt")', False), ("json.loads(data)", False)])
    return [f"def load{i}(data, f, p):", f"    return {call}"], [(1, MODEL)] if bad else []


def prompt(rng, i):
    """A chain of assignments from a source to an LLM call, broken or not on the way (subscripts are not followed)."""
    source, bad = rng.choice([("user_text", True), ('request.json', True), ('request.json["q"]', False), ('input("?")', True), ('os.getenv("Q")', True), ('"fixed"', False), ("LIMIT", False)])
    lines = [f"def ask{i}(user_text):", f"    v0 = {source}"]
    for k in range(1, rng.randint(2, 7)):
        step = rng.choice(["copy", "copy", "text", "clean", "over"])
        if step == "copy":
            lines.append(f"    v{k} = v{k - 1}")
        elif step == "text":
            lines.append(f'    v{k} = f"Do: {{v{k - 1}}}"')
        elif step == "clean":
            lines.append(f"    v{k} = sanitize(v{k - 1})")
            bad = False
        else:
            lines += [f"    v{k} = v{k - 1}", f'    v{k} = "constant"']
            bad = False
        if rng.random() < 0.2:
            lines.append(f"    other{k} = user_text")
    lines.append(f"    return client.chat.completions.create(messages=[{{'content': v{k}}}])")
    return lines, [(len(lines) - 1, PROMPT)] if bad else []


def test_planted_findings(spark, make_files):
    rng = random.Random(11)
    files, want = {}, set()
    for n in range(120):
        lines, path = ["import os"], f"p{n}.py"
        for i in range(rng.randint(1, 8)):
            part, hits = rng.choice([dynamic, shell, auth, model, prompt])(rng, i)
            want |= {(path, len(lines) + at + 1, category) for at, category in hits}
            lines += part + [""] * rng.randint(0, 2)
        files[path] = "\n".join(lines)
    files |= {"broken.py": "def unfinished(\neval('a' + 'b')", "empty.py": "", "note.txt": "eval('a' + 'b')"}
    facts = pf.py_facts(eligible_files(make_files({"r": files})))
    got = [(r.file_path, r.line_start, r.category) for r in prl.python_findings(facts).collect()]
    assert set(got) == want and len(want) > 150
