"""Expectations that don't come from the rules' own patterns: one text for each alternative, structure of JavaScript, long tokens, metadata rules."""

import time

import pytest
from pyspark.sql import functions as F

from palisade.functions import fixed, scanner
from palisade.functions.rulespec import TEXT_RULES
from palisade.functions.spans import running, spans
from palisade.operators import rules, scoring

ENTRY = "ecosystem string, name string, version string, ordinal long, path string, kind string, text string, mode int"
HOOK = "ecosystem string, name string, version string, hook string, kind string, body string, path string"


def as_of():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


#: Texts that a rule finds: of a source file (JavaScript, or Rust for CARGO), or of an install hook.
FOUND_IN_FILES = {
    "NPM004": ["Object.values(process.env)", "JSON.stringify( process.env )", "x = {...process.env}", "for (const k in process.env) {}", "for (k of Object.keys(process.env)) {}"],
    "NPM006": ["http://169.254.169.254/", "metadata.google.internal", "metadata.azure.com", "169.254.170.2/v2"],
    "NPM007": [f"go('https://{h}')" for h in ("webhook.site/x", "oast.fun", "oast.live", "requestbin.com", "pipedream.net", "beeceptor.com", "hookbin.com", "hookb.in", "interact.sh", "burpcollaborator.net", "canarytokens.com", "transfer.sh", "termbin.com", "dpaste.org", "pastebin.com", "ix.io", "discord.com/api/webhooks", "discordapp.com/api/webhooks", "hooks.slack.com/services", "api.telegram.org/bot")],
    "NPM008": ["~/.ssh/authorized_keys", "/.aws/credentials", "~/.npmrc", "~/.netrc", "/Library/LaunchAgents", "~/Library/LaunchDaemons", "~/.config/systemd/user", "/etc/systemd/system", "/etc/crontab", "/etc/cron.daily", "/var/spool/cron", "~/.bashrc", "~/.zshrc", "~/.profile"],
    "NPM010": ["WALLET.DAT", "keystore.json", "UTC--2020-01-01T", "/Library/Application Support/Exodus", "/.config/electrum", "/AppData/Roaming/Atomic", "nkbihfbeogaeaoehlefnkodbefgpgknn", "recovery phrase", "Seed-Phrase"],
    "NPM011": ["process.env.GH_TOKEN", "process . env . AWS_SECRET_ACCESS_KEY", "process.env['NPM_AUTH']", "_authToken = x", "npm config get _authToken", "/.npmrc'", "/.docker/config.json", "/.git-credentials"],
    "NPM013": ["require(atob('x'))", "import(globalThis['x'])", "require(String.fromCharCode(1))", "require(process.env.X)", "require(`./${x}`)"],
    "NPM015": ["[104,116,116,112]", "0x68, 0x74, 0x74, 0x70"],
    "NPM017": ["raw.githubusercontent.com", "gist.githubusercontent.com", "//gitlab.com/a/b/-/raw/x", "bitbucket.org/a/b/raw/", "codeload.github.com"],
    "NPM018": ["fs.rmSync(__dirname)", "fs.promises.unlink(__filename)", "require('fs').rm(__filename)"],
    "NPM020": ["Function(atob('x'))()", "eval(Buffer.from(y))", "eval(decodeURIComponent(escape(z)))"],
    "NPM024": ["stratum+ssl://x", "//pool.minexmr.com/", "cryptonight_hash", "randomx_init", "Coinhive", "CoinHive.Anonymous"],
    "NPM025": ["dns.resolveTxt(`${x}`)", "dnsPromises.lookup(atob(x))", "dns.resolve4(data + '.x')"],
    "NPM033": ["ACME_PRIVATE_KEY", "MNEMONIC", "SEED_PHRASE", "'0x" + "ab" * 32 + "'"],
    "NPM035": ["/etc/sudoers", "/proc/self/environ", "/proc/12/cmdline", "/var/log/auth.log", "/var/log/secure", "/root/.ssh"],
    "NPM037": ["require.main.path; x === 'lodash'", "process.mainModule; '../node_modules/left-pad'", "process.mainModule.filename.indexOf('abc')"],
    "NPM038": ["require.cache[x] = y", "Module._cache[a] = b", "delete Module._cache[a]"],
    "NPM039": ["rimraf(os.homedir())", "fs.rmSync(p, {recursive: true}); process.env.HOME", "`x`; sh = 1; rimraf(process.cwd())", "fs.promises.rm(d, { force: 1, recursive: true }, '/')"],
    "NPM041": ["JSON.stringify(process.env); https.request(x)", "const {A} = process.env; axios.post(x)", "process.env[k]; new WebSocket(u)", "x = {...process.env}; net.connect(1)", "Object.fromEntries(process.env); dns.lookup(x)"],
    "NPM044": ["process.dlopen(m)", "process._linkedBinding('x')", "process._rawDebug(1)"],
    "CARGO005": ["std::process::Command", "Command :: new(x)", "std::os::unix::process"],
    "CARGO006": ["std::fs::read_dir(x)", "OpenOptions::new()", "File::open(p)"],
    "CARGO007": ["std::net::UdpSocket", "TcpStream::connect(a)", "ureq::get(u)", "tokio::net"],
}
FOUND_IN_HOOKS = {
    "NPM002": ["require('net')", "spawnSync(x)", "execFile(x)", "fork(x)"],
    "NPM019": ["wget x | bash", "$(curl x)", "`fetch x`", "CURL x | Python3"],
    "NPM023": ["https.get(u)", "require('axios').post(u)", "fetch(u)", "axios(u)", "got.stream(u)", "superagent.get(u)", "undici.request(u)", "new XMLHttpRequest()"],
    "NPM034": ["npm token", "npx thing", "pnpm publish", "cargo login", "twine upload", "dotnet nuget push"],
    "NPM036": ["fs.chmodSync(p, 0o755)", "chmod 755 x", "chmod +x y"],
    "CARGO002": ["Command::new(x)", "std::process::exit(1)", "std::net::TcpListener", "UdpSocket::bind(a)", "reqwest::get"],
    "CARGO004": ['include_str!("x")'],
    "PYPI002": ["from urllib import x", "os.system(x)", "subprocess.run(x)", "socket.socket()", "urllib.request.urlopen(u)", "requests.post(u)", "__import__('socket')", "exec(x)", "compile(a, b, 'exec')"],
    "NUGET002": ["iwr x", "New-Object System.Net.WebClient", "System.Net.Sockets.TcpClient", "x.DownloadString('u')", "invoke-expression x", "[System.Reflection.Assembly]::Load(x)", "[System.Convert]::FromBase64String(x)", "-EncodedCommand x"],
}
#: Rules that must not fire in a file: hits in comments, strings and templates, and near misses.
ABSENT = [
    ("NPM038", "/* how a loader could be fooled: require.cache[key] = fake */ show(size(require.cache));"), ("NPM038", "help(`write require.cache[id] = module to swap a module`);"),
    ("NPM018", "run(); // an installer may call fs.unlinkSync(__filename) at its end"), ("NPM015", "/* bytes 104, 116, 116, 112 begin a web address */ open(page);"),
    ("NPM044", "warn('process.dlopen(lib, path) is not allowed');"), ("NPM039", "usage(`${tool} calls rimraf(os.homedir()) never`); home(os.homedir());"),
    ("NPM005", "/* eval(code) was removed in 2.0 */ table = '" + "QUJD" * 500 + "';"), ("NPM007", "https://notwebhook.site.example"), ("NPM041", "JSON.stringify(process.env)"), ("NPM037", "require.main.filename"),
    ("NPM038", "a = `one ${`two ${`three ${'require.cache[q] = w'}`}`}`; b()"), ("NPM018", "s = /[\"]/; t = 'fs.unlinkSync(__filename)';"),
]
PRESENT = [
    ("NPM038", "x = /[\"'`]/; require.cache[target] = y"), ("NPM038", "it = `a ${`b`} c`; require.cache[t] = y"), ("NPM018", "s = 'it\\'s'; fs.unlinkSync(__filename)"), ("NPM044", "/* a */ process.dlopen(m) // b"),
    ("NPM005", "eval(x); y = '" + "QUJD" * 300 + "'"), ("NPM038", "open('; // delete require.cache[x]"), ("NPM018", "f({ a: `fs.unlinkSync(__filename)`"), ("NPM044", "x = a / 2; process.dlopen(m) / 'b'"),
]  # fmt: skip  of sources that don't balance, hits in strings count, too


@pytest.fixture(scope="module")
def found(spark):
    """The rules found in each text, each in a package of its own."""
    files = [(rule, t) for rule, texts in FOUND_IN_FILES.items() for t in texts] + ABSENT + PRESENT
    hooks = [(rule, t) for rule, texts in FOUND_IN_HOOKS.items() for t in texts]
    eco = lambda rule: next(e for e in ("cargo", "pypi", "nuget", "npm") if rule.lower().startswith(e))
    entries = [(eco(r), f"f{i}", "1", 0, "src/a.js", "rust_source" if r.startswith("CARGO") else "js_source", t, 0o644) for i, (r, t) in enumerate(files)]
    lifecycle = [(eco(r), f"h{i}", "1", "x", "install_time", t, None) for i, (r, t) in enumerate(hooks)]
    e, h = spark.createDataFrame(entries, ENTRY), spark.createDataFrame(lifecycle, HOOK)
    crates = e.where("ecosystem = 'cargo'").select(*rules.PACKAGE)
    out = {}
    for r in rules.unit_findings(rules.units(e, h), crates, as_of()).collect():
        out.setdefault(r["name"], set()).add(r["rule_id"])
    named = {("file", rule, t): f"f{i}" for i, (rule, t) in enumerate(files)} | {("hook", rule, t): f"h{i}" for i, (rule, t) in enumerate(hooks)}
    return {key: out.get(name, set()) for key, name in named.items()}


def test_every_alternative_is_found(found):
    missed = [(rule, t) for rule, texts in FOUND_IN_FILES.items() for t in texts if rule not in found["file", rule, t]]
    missed += [(rule, t) for rule, texts in FOUND_IN_HOOKS.items() for t in texts if rule not in found["hook", rule, t]]
    assert missed == []


def test_comments_strings_and_near_misses(found):
    assert [(r, t) for r, t in ABSENT if r in found["file", r, t]] == [] and [(r, t) for r, t in PRESENT if r not in found["file", r, t]] == []


def test_hints_lose_nothing(spark):
    texts = {t for texts in (*FOUND_IN_FILES.values(), *FOUND_IN_HOOKS.values()) for t in texts}
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("low", F.lower("text"))
    hinted = [r for r in TEXT_RULES if r.hints]
    lost = [F.count_if(F.col("text").rlike(f"(?d){r.pattern}") & ~F.expr(rules.hinted(r))).alias(r.id) for r in hinted]
    assert set(df.agg(*lost).first()) == {0}


def test_distance_runs_from_the_call(spark):
    blob = "QUJD" * 300
    cases = {"near": f"'{blob}'" + " " * 4095 + "eval(x)", "far": f"'{blob}'" + " " * 4096 + "eval(x)", "before": "eval(" + " " * 4090 + f"'{blob}'", "beyond": "eval(" + " " * 4091 + f"'{blob}'", "wide": f"'{blob}'" + "é" * 2100 + " eval(x)"}
    e = spark.createDataFrame([("npm", k, "1", 0, "a.js", "js_source", t, 0) for k, t in cases.items()], ENTRY)
    got = {r["name"] for r in rules.blob_near_execution(rules.units(e, spark.createDataFrame([], HOOK))).collect()}
    assert got == {"near", "before"}


def test_long_tokens_need_no_stack(spark):
    n = 1_000_000
    texts = ["`" + "x" * n + "` eval(", '"' + "\\n" * (n // 2) + '" eval(', "/*" + "* " * (n // 2) + "*/ eval(", "//" + "a" * n + "\neval(", "`${" + "a" * n + "} eval(`", "'" + "y" * n, "/* eval(" + "*" * n]
    start = time.time()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: r["x"] for r in df.withColumn("js", scanner.scanned(F.col("text"))).select("i", scanner.inside(F.col("js"), F.regexp_instr("text", F.lit("eval")) - 1).alias("x")).collect()}
    assert got == {0: False, 1: False, 2: False, 3: False, 4: True, 5: False, 6: False}
    entries = spark.createDataFrame([("npm", str(i), "1", 0, "a.js", "js_source", t, 0) for i, t in enumerate(texts)], ENTRY)
    rules.unit_findings(rules.units(entries, spark.createDataFrame([], HOOK)), entries.select(*rules.PACKAGE).limit(0), as_of()).collect()
    assert time.time() - start < 120


def test_spans_of_many_matches(spark):
    start = time.time()
    df = spark.createDataFrame([("ab1 " * 200_000,), ("",), ("😀1",)], "text string")
    got = [r["s"] for r in df.select(spans(F.col("text"), "[0-9]").alias("s")).collect()]
    assert len(got[0]) == 200_000 and tuple(got[0][-1]) == (799_998, 799_999, 1) and got[1] == [] and tuple(got[2][0]) == (1, 2, 1)
    sums = spark.sql("SELECT array(3, 1, 2, 5, 4) v").select(running(F.col("v"), lambda a, b: a + b).alias("s"), running(F.col("v"), F.greatest).alias("m")).first()
    assert sums["s"] == [3, 4, 6, 11, 15] and sums["m"] == [3, 3, 3, 5, 5] and time.time() - start < 60


def manifest(spark, raw, bins="map('x', './bin/x')"):
    return spark.sql(f"SELECT 'npm' ecosystem, cast(i AS string) name, '1' version, {bins} bin, raw FROM VALUES {', '.join(f'({i}, {chr(39)}{r}{chr(39)})' for i, r in enumerate(raw))} t(i, raw)")


def test_bundled_dependencies(spark):
    raw = ['{"bundleDependencies": ["a", 1, "b"]}', '{"bundleDependencies": {"x": 1}, "bundledDependencies": true}', '{"bundleDependencies": ["a"], "bundledDependencies": ["c"]}', '{"bundleDependencies": false}', '{"bundleDependencies": "true"}', "no json"]
    assert {r["name"]: r["excerpt"] for r in rules.bundled_dependencies(manifest(spark, raw)).collect()} == {"0": "a, b", "1": "*", "2": "a, c"}


@pytest.mark.parametrize(
    "patterns,extra",
    [
        ('["dist", "lib/*.js"]', "x.js, lib/a.ts"), ('["./dist/", "x.js", "lib/**"]', None), ('["**/a.js", "**/b.js"]', "x.js, lib/a.ts"), ('["lib*", "dist"]', "x.js"), ('["*.js"]', "lib/a.ts"), ('["?.js"]', "lib/a.js, dist/deep/b.js, x.js, lib/a.ts"),
        ('[]', "lib/a.js, dist/deep/b.js, x.js, lib/a.ts"), ('[7, "lib"]', "dist/deep/b.js, x.js"),
    ],
)
def test_files_list_patterns(spark, patterns, extra):
    e = spark.createDataFrame([("npm", "0", "1", i, f, "text", "", 0) for i, f in enumerate(["package.json", "readme.MD", "lib/a.js", "dist/deep/b.js", "x.js", "lib/a.ts", "bin/x", "main.js"])], ENTRY)
    found = [r["excerpt"] for r in rules.unlisted_files(e, manifest(spark, ['{"main": "./main.js", "files": ' + patterns + "}"])).collect()]
    assert found == ([extra] if extra else [])


def test_hidden_unicode(spark):
    texts = {"bidi": "é ‮ x", "zero": "a​b", "mixed": "var Bаnk = 1", "string": "s = 'Bаnk \\' аa'", "comment": "// Bаnk", "other": "банк", "bom": "x﻿"}
    e = spark.createDataFrame([("npm", k, "1", 0, "a.js", "js_source", t, 0) for k, t in texts.items()], ENTRY)
    got = {(r["name"], r["excerpt"], r["severity"], r["defers"]) for r in rules.hidden_unicode(rules.units(e, spark.createDataFrame([], HOOK))).collect()}
    assert got == {("bidi", "bidi override U+202E at offset 3", "critical", False), ("zero", "zero-width U+200B at offset 1", "high", True), ("bom", "zero-width U+FEFF at offset 1", "high", True), ("mixed", "Bаnk", "high", True), ("comment", "Bаnk", "high", True)}


def test_minified(spark):
    mini, plain = "var a=1;" * 200, "var a = 1;\n" * 20
    files = {
        "alone": [("dist/a.js", mini)], "map": [("dist/a.js", mini), ("dist/a.js.map", "{}")], "ts": [("dist/a.js", mini), ("src/a.ts", plain)], "readable": [("lib/a.js", mini), ("src/a.js", plain)], "stem": [("x/bundles/a.min.js", mini), ("src/a.js", plain)],
        "esm": [("esm/a.js", mini)], "src": [("src/lib/a.js", mini)], "escapes": [("out/a.js", "\\x41\\u0042" * 40)], "mjs": [("dist/a.js", mini), ("src/a.mjs", plain)], "hint": [("dist/a.bundle.js", mini), ("a.bundle.js", plain)], "short": [("dist/a.js", "x" * 999)],
    }
    rows = [("npm", k, "1", i, p, "text" if p.endswith(".map") else "js_source", t, 0) for k, fs in files.items() for i, (p, t) in enumerate(fs)]
    got = {r["name"] for r in rules.minified_only(spark.createDataFrame(rows, ENTRY)).collect()}
    assert got == {"alone", "stem", "escapes", "mjs", "hint"}


def test_packages_of_several_files(spark):
    """NPM035 counts in the first file only, other rules in each; a package's score is the sum over files and hooks."""
    files = [("b.js", "read('/etc/shadow')"), ("a.js", "read('/etc/sudoers'); fetch('http://169.254.169.254')"), ("c.js", "x = '/root/.ssh'")]
    e = spark.createDataFrame([("npm", "p", "1", i, p, "js_source", t, 0) for i, (p, t) in enumerate(files)], ENTRY)
    h = spark.createDataFrame([("npm", "p", "1", "postinstall", "install_time", "x /etc/shadow 169.254.169.254", None), ("npm", "q", "1", "test", "other", "x", None)], HOOK)
    out = rules.unit_findings(rules.units(e, h), e.select(*rules.PACKAGE).limit(0), as_of())
    assert sorted((r["rule_id"], r["location"]) for r in out.collect()) == [("NPM001", "package.json#scripts.postinstall"), ("NPM006", "a.js"), ("NPM006", "package.json#scripts.postinstall"), ("NPM035", "b.js")]
    got = {r["name"]: (r["score"], r["verdict"], r["capabilities"]) for r in scoring.stage1(out, e.select(*rules.PACKAGE).unionByName(h.select(*rules.PACKAGE))).collect()}
    assert got == {"p": (25, "malicious", ["lifecycle_install", "net_http", "fs_read_sensitive"]), "q": (0, "clean", [])}


def test_report_order(spark):
    df = spark.createDataFrame([(r,) for r in ("NPM006", "NPM041", "NPM037", "NPM002", "X")], "rule_id string")
    assert [r["rule_id"] for r in rules.in_report_order(df).orderBy("ordinal").collect()] == ["NPM002", "NPM041", "NPM037", "NPM006", "X"]
    assert len(set(fixed.RULE_ORDER)) == 50
