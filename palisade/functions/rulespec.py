"""Rules as data: where they look, what they match, and what a finding says."""

from __future__ import annotations

from dataclasses import dataclass, field

from palisade.functions.fixed import PATTERNS

ALL = ("npm", "cargo", "pypi", "nuget")
#: Kinds of entries that hold no text to scan.
BINARY_KINDS = ("native_binary", "binary")


@dataclass(frozen=True)
class Scope:
    """Units that a rule looks at: S scannable entries, J JavaScript or text entries, R Rust sources of macro crates, D root
    documents; LI, LP hooks run at install or publish time, L any hook."""

    units: tuple[str, ...]
    severity: str
    capabilities: tuple[str, ...] = ()


@dataclass(frozen=True)
class TextRule:
    """Finds the first match of a pattern in a unit's text.

    also: a second pattern that must match too; instead: one to try where the first doesn't match, in entries only or anywhere.
    """

    id: str
    ecosystems: tuple[str, ...]
    scopes: tuple[Scope, ...]
    pattern: str
    category: str
    defers: bool = False
    group: int = 0
    also: str | None = None
    instead: str | None = None
    hints: tuple[str, ...] = ()  # a match of the pattern holds one of these (in lower case where the pattern ignores case)
    suppress: str | None = None  # "all", or "js": hits inside comments and strings don't count in such entries
    message: str = field(default="", compare=False)


def alternatives(name: str, ignore_case: bool = False) -> str:
    """The pattern of that name, in the dialect that both engines share."""
    return ("(?i)" if ignore_case else "") + "|".join(PATTERNS[name])


def _delimited(name: str) -> str:
    return "(?:^|[^A-Za-z0-9_.-])(" + "|".join(PATTERNS[name]) + ")(?:[^A-Za-z0-9_.-]|$)"


def one(units: str, severity: str, *capabilities: str) -> tuple[Scope, ...]:
    return (Scope(tuple(units.split()), severity, capabilities),)


ANY_LINE = r"[\s\S]"  # presence rules match any text, the empty one too

#: In the order in which findings are reported.
TEXT_RULES = [
    TextRule("NPM002", ("npm",), one("LI", "high", "lifecycle_install", "install_time_shell", "proc_spawn"), alternatives("dangerous_api"), "lifecycle_script", True, hints=("child_process", "require", "spawn", "exec", "fork"), message="install hook uses process or network APIs"),
    TextRule("NPM004", ("npm",), one("LI J", "high", "env_bulk_enum"), alternatives("env_bulk"), "exfil", True, hints=("env",), message="reads the whole environment"),
    TextRule("NPM006", ALL, one("S L", "critical", "net_http"), alternatives("metadata_host"), "exfil", hints=("169.254.", "metadata."), message="contacts a cloud metadata service"),
    TextRule("NPM007", ALL, one("S L", "critical", "net_http"), _delimited("exfil_host"), "exfil", group=1, hints=("webhook.site", "oast.", "requestbin.", "pipedream.net", "beeceptor.com", "hookbin.com", "hookb.in", "interact.sh", "burpcollaborator.net", "canarytokens.com", "transfer.sh", "termbin.com", "dpaste.", "pastebin.com", "ix.io", "discord.com", "discordapp.com", "hooks.slack.com", "api.telegram.org"), message="names a known exfiltration host"),
    TextRule("NPM008", ALL, one("S L", "high", "fs_write_persistence"), alternatives("persistence"), "persistence", True, hints=(".ssh/", ".aws/", ".npmrc", ".netrc", "Library/Launch", ".config/systemd", "/etc/systemd", "/etc/cron", "/var/spool/cron", ".bashrc", ".zshrc", ".profile"), message="names a path used for persistence"),
    TextRule("NPM010", ("npm",), one("S L", "critical", "wallet_access"), alternatives("wallet", True), "exfil", hints=("wallet.dat", "keystore.json", "utc--", "library/application", ".config/", "appdata/roaming/", "nkbihfbeogaeaoehlefnkodbefgpgknn", "bfnaelmomeimhlpmgjnjophhpkkoljpa", "hnfanknocfeofbddgcijnmhnfnkdnaad", "bealhdmppppfdbnlkjkjeohpoacajcanj", "recovery", "seed"), message="looks for wallets"),
    TextRule("NPM011", ("npm",), (*one("LI", "critical", "lifecycle_install", "install_time_network", "env_secret_lookup"), *one("S", "high", "env_secret_lookup")), alternatives("token"), "exfil", True, hints=("process", "_authToken", ".npmrc", ".docker/config.json", ".git-credentials"), message="reads registry or cloud tokens"),
    TextRule("NPM013", ("npm",), one("J L", "high", "dynamic_require"), alternatives("dynamic_require"), "obfuscation", True, hints=("require", "import"), message="computes what it loads"),
    TextRule("NPM015", ("npm",), one("S L", "critical", "encoded_payload"), alternatives("encoded_url", True), "obfuscation", suppress="js", hints=("104", "68"), message="spells a URL in character codes"),
    TextRule("NPM017", ("npm",), (*one("LI", "critical", "lifecycle_install", "install_time_network", "net_http"), *one("S", "high", "net_http")), alternatives("raw_fetch", True), "exfil", True, hints=("githubusercontent.com", "gitlab.com/", "bitbucket.org/", "codeload.github.com"), message="fetches raw files from a code host"),
    TextRule("NPM018", ("npm",), one("J L", "critical", "fs_read", "self_delete"), alternatives("self_delete"), "persistence", suppress="all", hints=("__file", "__dir"), message="deletes itself"),
    TextRule("NPM019", ("npm",), one("LI", "critical", "lifecycle_install", "install_time_shell", "proc_spawn"), alternatives("shell_pipe", True), "lifecycle_script", hints=("curl", "wget", "fetch"), message="pipes a download into an interpreter"),
    TextRule("NPM020", ("npm",), one("J L", "critical", "dynamic_eval", "encoded_payload"), alternatives("eval_atob"), "obfuscation", hints=("eval", "Function", "constructor"), message="evaluates decoded text"),
    TextRule("NPM023", ("npm",), one("LI", "high", "lifecycle_install", "install_time_network", "net_http"), alternatives("install_http"), "lifecycle_script", True, hints=("http", "fetch", "axios", "got", "superagent", "undici", "XMLHttpRequest", "WebSocket"), message="install hook makes web requests"),
    TextRule("NPM024", ALL, one("S L", "critical", "crypto_miner"), alternatives("miner", True), "exfil", instead=alternatives("monero_address"), hints=("stratum+", "minexmr.com", "xmrpool.eu", "nanopool.org", "supportxmr.com", "moneroocean.stream", "herominers.com", "hashvault.pro", "c3pool.com", "f2pool.com", "ethermine.org", "flexpool.io", "2miners.com", "crypto-pool.fr", "coin-hive.com", "coinhive", "webminerpool", "cryptoloot", "crypto-loot.com", "cryptonight", "randomx_", "jsecoin"), message="mines, or pays a miner"),
    TextRule("NPM025", ("npm",), one("J L", "high", "net_dns"), alternatives("dns_exfil"), "exfil", True, hints=("dns",), message="resolves computed names"),
    TextRule("NPM026", ("npm",), one("D", "critical"), alternatives("document_code", True), "obfuscation", instead=alternatives("base64_blob"), message="code or a blob in a document"),
    TextRule("NPM027", ("npm",), one("LP", "medium"), "|".join([alternatives("dangerous_api"), alternatives("publish_extra")]), "lifecycle_script", True, message="publish hook uses process or network APIs"),
    TextRule("NPM033", ("npm",), one("J", "high", "secret_material"), alternatives("secret_material"), "exfil", True, hints=("_PRIVATE_KEY", "MNEMONIC", "SEED_PHRASE", "0x"), message="holds secret material (reconstructed rule)"),
    TextRule("NPM034", ("npm",), one("LI", "critical", "lifecycle_install", "install_time_shell", "registry_write"), alternatives("registry_write"), "lifecycle_script", message="install hook writes to a registry"),
    TextRule("NPM035", ALL, one("S", "high", "fs_read_sensitive"), alternatives("privileged_path"), "persistence", True, hints=("/etc/", "/proc/", "/var/log/", "/root/"), message="reads privileged paths"),
    TextRule("NPM036", ("npm",), one("LI", "high", "lifecycle_install", "install_time_shell", "native_binary"), alternatives("chmod"), "lifecycle_script", True, hints=("chmod",), message="install hook makes files executable"),
    TextRule("NPM037", ("npm",), one("J", "high", "dynamic_eval", "time_bomb"), alternatives("main_module"), "obfuscation", True, also=alternatives("name_compared"), hints=("require", "mainModule"), message="acts by the name of the main module"),
    TextRule("NPM038", ("npm",), one("J", "high", "dynamic_require", "dynamic_eval"), alternatives("require_cache"), "obfuscation", True, suppress="all", hints=("cache",), message="changes the module cache"),
    TextRule("NPM039", ("npm",), one("J L", "critical", "destructive_fs"), alternatives("destructive"), "persistence", also=alternatives("traversal_seed"), suppress="all", hints=("rimraf", "rm", "del"), message="deletes trees from a root"),
    TextRule("NPM041", ("npm",), (*one("LI", "critical", "lifecycle_install", "install_time_network", "env_bulk_enum", "env_secret_lookup"), *one("J", "high", "env_bulk_enum", "env_secret_lookup")), alternatives("env_read"), "exfil", True, also=alternatives("sink"), hints=("env",), message="sends what it reads from the environment"),
    TextRule("NPM044", ("npm",), one("J", "high", "dynamic_eval", "v8_internal"), alternatives("v8_internal"), "obfuscation", True, suppress="all", hints=("process",), message="uses internal bindings"),
    TextRule("CARGO002", ("cargo",), one("LI", "high"), alternatives("cargo_dangerous"), "lifecycle_script", True, message="build script uses process or network APIs"),
    TextRule("CARGO004", ("cargo",), one("LI", "high"), alternatives("include_payload"), "obfuscation", True, message="build script embeds a file"),
    TextRule("CARGO005", ("cargo",), one("R", "high", "proc_spawn"), alternatives("macro_process"), "other", True, message="macro crate spawns processes"),
    TextRule("CARGO006", ("cargo",), one("R", "high", "fs_read"), alternatives("macro_files"), "other", True, message="macro crate uses files"),
    TextRule("CARGO007", ("cargo",), one("R", "high", "net_http"), alternatives("macro_network"), "other", True, message="macro crate uses the network"),
    TextRule("PYPI002", ("pypi",), one("LI", "high"), alternatives("python_dangerous"), "lifecycle_script", True, message="setup script uses process or network APIs"),
    TextRule("NUGET002", ("nuget",), one("LI", "high"), alternatives("powershell", True), "lifecycle_script", True, message="install script uses process or network APIs"),
]
#: A hook that runs at install time is worth a note in itself.
PRESENCE_RULES = {"npm": ("NPM001", ("lifecycle_install",)), "cargo": ("CARGO001", ()), "pypi": ("PYPI001", ()), "nuget": ("NUGET001", ())}
