"""Closed vocabularies and rule catalogs, as data."""

from __future__ import annotations

# The closed vocabularies, in their ordinal order.
CAPABILITIES = ["network", "file_read", "file_write", "process_exec", "env_access", "unsafe_code", "ffi", "crypto", "system_time", "proc_macro"]
ORIGINS = ["import", "string_literal", "attribute", "code_site", "manifest_hook"]
LANGUAGES = ["rust", "python", "java_script", "type_script", "go", "bash"]
CONTEXTS = ["runtime", "build_hook", "install_hook", "generator"]
TIERS = ["syntactic", "semantic", "data_flow"]
FLOW_KINDS = ["taint-flow", "dead-store", "discarded-result", "partial-error-handling", "repeated-call", "unnecessary-clone", "allocation-in-loop", "redundant-collect", "lock-across-await", "inconsistent-lock-order", "immutable-growable", "swallowed-ok", "unobserved-spawn"]
EDGE_KINDS = ["call", "import", "implementation", "reference", "depends_on"]
STATUSES = ["complete", "unavailable", "not_applicable"]
LEVELS = {"analysis-incomplete": 0, "new-dependency": 1, "new-capability": 2, "hash-mismatch": 3}

# Capability gate rules as (name, severity, rationale), in catalog order.
GATE_RULES = [
    ("build-script-network", "deny", "Build scripts should not make network requests"),
    ("build-script-exec", "warn", "Build scripts spawning processes is common (cc, pkg-config) but risky"),
    ("build-script-download-exec", "deny", "Download-and-execute in build script — classic supply chain attack"),
    ("build-script-file-write", "warn", "Build scripts writing outside OUT_DIR is suspicious"),
    ("proc-macro-network", "deny", "Proc macros have no legitimate reason for network access"),
    ("proc-macro-exec", "deny", "Proc macros have no legitimate reason to spawn processes"),
    ("proc-macro-file-write", "deny", "Proc macros should not write to the filesystem"),
    ("env-access-network", "info", "Reading environment variables and accessing network — review for credential harvesting"),
    ("key-material-network", "warn", "Embedded key material with network access — verify intent"),
    ("env-to-network", "deny", "Environment variable value reaches a network call — potential credential exfiltration"),
    ("file-to-network", "deny", "File content reaches a network call — potential data exfiltration"),
    ("network-to-exec", "deny", "Network-sourced data reaches process execution — remote code execution risk"),
    ("dead-store", "warn", "Dead store indicates wasted computation or a missing read"),
    ("discarded-result", "warn", "Discarded Result silently drops errors — handle or explicitly discard"),
    ("partial-error-handling", "warn", "Inconsistent error handling — some branches swallow errors silently"),
    ("swallowed-ok", "warn", ".ok() silently drops the error — handle the Result or explicitly discard with comment"),
    ("immutable-growable", "info", "Immutable growable collection — use Box<[T]> or Box<str> instead"),
    ("repeated-call", "info", "Repeated call with same arguments — cache the result in a local binding"),
    ("unnecessary-clone", "info", "Unnecessary clone — move the original instead of copying"),
    ("allocation-in-loop", "info", "Allocation per iteration — hoist outside the loop and reuse with clear()"),
    ("redundant-collect", "info", "Redundant collect — chain iterator operations without intermediate Vec"),
    ("lock-across-await", "deny", "Lock guard held across await — potential deadlock or task starvation"),
    ("inconsistent-lock-order", "deny", "Inconsistent lock ordering across functions — potential deadlock"),
    ("unobserved-spawn", "warn", "Dropped JoinHandle means panics in the spawned thread/task vanish silently"),
]
# Module-boundary gate rules, in catalog order.
BOUNDARY_RULES = [
    ("large-scc", "warn", "cyclic component exceeds max-scc-members"),
    ("boundary-crossing-scc", "deny", "cycle crosses declared module partitions"),
    ("misplaced-symbol", "warn", "foreign-edge affinity meets the misplaced-symbol threshold"),
    ("low-module-cohesion", "warn", "internal-edge cohesion is below the configured threshold"),
]

# Path prefixes and the capability that they show, in lookup order.
RUST_PREFIXES = [
    ("std::net", "network"), ("tokio::net", "network"), ("reqwest", "network"), ("hyper", "network"), ("ureq", "network"), ("curl", "network"), ("tungstenite", "network"),
    ("std::fs", "file_read"), ("tokio::fs", "file_read"), ("walkdir", "file_read"), ("glob", "file_read"), ("tempfile", "file_write"),
    ("std::process", "process_exec"), ("tokio::process", "process_exec"), ("duct", "process_exec"),
    ("std::env::var", "env_access"), ("std::env::vars", "env_access"), ("dotenvy", "env_access"), ("envy", "env_access"),
    ("libc", "ffi"), ("nix", "ffi"), ("winapi", "ffi"), ("windows_sys", "ffi"),
    ("ring", "crypto"), ("rustls", "crypto"), ("openssl", "crypto"), ("aes", "crypto"), ("sha2", "crypto"), ("hmac", "crypto"), ("ed25519_dalek", "crypto"), ("x25519_dalek", "crypto"),
    ("std::time::SystemTime", "system_time"), ("std::time::Instant", "system_time"), ("chrono", "system_time"), ("time", "system_time"),
]
FS_WRITE_ROOTS = ["std::fs::", "tokio::fs::"]
FS_WRITE_NAMES = ["copy", "create_dir", "create_dir_all", "hard_link", "remove_dir", "remove_dir_all", "remove_file", "rename", "set_permissions", "write"]
ATTRIBUTE_CAPABILITIES = {"link": "ffi", "proc_macro": "proc_macro", "proc_macro_derive": "proc_macro", "proc_macro_attribute": "proc_macro"}

# Imported modules by language, in lookup order.
IMPORTS = {
    "python": [("socket", "network"), ("urllib", "network"), ("requests", "network"), ("httpx", "network"), ("aiohttp", "network"), ("subprocess", "process_exec"), ("dotenv", "env_access"), ("cryptography", "crypto"), ("hashlib", "crypto"), ("hmac", "crypto"), ("Crypto", "crypto"), ("ctypes", "ffi"), ("cffi", "ffi")],
    "java_script": [("http", "network"), ("https", "network"), ("axios", "network"), ("node-fetch", "network"), ("got", "network"), ("fs", "file_read"), ("child_process", "process_exec"), ("execa", "process_exec"), ("shelljs", "process_exec"), ("dotenv", "env_access"), ("crypto", "crypto"), ("bcrypt", "crypto"), ("jose", "crypto"), ("ffi-napi", "ffi"), ("node-ffi", "ffi")],
    "go": [("net", "network"), ("crypto", "crypto"), ("os/exec", "process_exec"), ("C", "ffi"), ("unsafe", "unsafe_code")],
}
# Text that shows a call, its capability and the evidence reported.
CALLS = {
    "python": [
        ("os.system(", "process_exec", "os.system"),
        ("os.execl(", "process_exec", "os.exec*"), ("os.execle(", "process_exec", "os.exec*"), ("os.execlp(", "process_exec", "os.exec*"), ("os.execlpe(", "process_exec", "os.exec*"),
        ("os.execv(", "process_exec", "os.exec*"), ("os.execve(", "process_exec", "os.exec*"), ("os.execvp(", "process_exec", "os.exec*"), ("os.execvpe(", "process_exec", "os.exec*"),
        ("os.environ", "env_access", "os.environ"), ("os.getenv(", "env_access", "os.getenv"), ("open(", "file_read", "open()"),
        ("shutil.copy(", "file_write", "shutil.copy"), ("shutil.copy2(", "file_write", "shutil.copy"), ("shutil.copytree(", "file_write", "shutil.copy"), ("shutil.move(", "file_write", "shutil.move"), ("shutil.rmtree(", "file_write", "shutil.rmtree"),
    ],
    "java_script": [("fetch(", "network", "fetch"), ("process.env", "env_access", "process.env")],
    "go": [("os.Open(", "file_read", "os.Open"), ("os.Create(", "file_write", "os.Create"), ("os.ReadFile(", "file_read", "os.ReadFile"), ("os.WriteFile(", "file_write", "os.WriteFile"), ("os.Getenv(", "env_access", "os.Getenv"), ("os.Environ(", "env_access", "os.Environ"), ("exec.Command(", "process_exec", "exec.Command"), ("syscall.Exec(", "process_exec", "syscall.Exec")],
}
# Shell commands by capability group, in scan order, and the interpreters that hooks start.
SHELL_NETWORK = ["curl", "wget", "nc", "ncat", "ssh", "scp", "rsync"]
SHELL_WRITE = ["cp", "mv", "rm", "mkdir", "touch", "tee", "dd"]
SHELL_EXEC = ["exec", "eval", "bash -c", "sh -c"]
SHELL_ENV = ["env", "printenv", "export"]
SHELL_CRYPTO = ["openssl", "gpg", "ssh-keygen"]
HOOK_INTERPRETERS = ["bash", "sh", "python", "node"]
NPM_HOOKS = ["preinstall", "install", "postinstall"]

# Manifest file names, extensions and interpreters by language.
MANIFESTS = ["package.json", "setup.py", "pyproject.toml", "Makefile", "makefile", "GNUmakefile", "justfile", "Justfile"]
EXTENSIONS = {"rs": "rust", "py": "python", "js": "java_script", "jsx": "java_script", "mjs": "java_script", "cjs": "java_script", "ts": "type_script", "tsx": "type_script", "mts": "type_script", "cts": "type_script", "go": "go", "sh": "bash", "bash": "bash", "zsh": "bash"}
INTERPRETERS = {"bash": "bash", "sh": "bash", "zsh": "bash", "python": "python", "python3": "python", "node": "java_script"}

# The check codes with description, category and whether they are marked as typical of generated code.
CHECKS = [
    ("max-depth", "Excessive nesting depth", "nesting", False), ("nested-if", "If nested inside if", "nesting", False), ("if-in-match", "If inside match arm", "nesting", False),
    ("nested-match", "Match nested inside match", "nesting", False), ("match-in-if", "Match inside if branch", "nesting", False), ("else-chain", "Long if/else if chain", "nesting", False),
    ("forbidden-attribute", "Forbidden attribute pattern", "forbid_attributes", True), ("forbidden-type", "Forbidden type pattern", "forbid_types", True), ("forbidden-call", "Forbidden method call pattern", "forbid_calls", True), ("forbidden-macro", "Forbidden macro pattern", "forbid_macros", True),
    ("forbidden-else", "Use of `else` keyword (style preference)", "forbid_else", False), ("forbidden-unsafe", "Use of `unsafe` keyword", "forbid_unsafe", False),
    ("dyn-return", "Dynamic dispatch in return type (`Box<dyn T>`, `Arc<dyn T>`)", "dispatch", True), ("dyn-param", "Dynamic dispatch in function parameter (`&dyn T`, `Box<dyn T>`)", "dispatch", True), ("vec-box-dyn", "`Vec<Box<dyn T>>` prevents cache locality and inlining", "dispatch", True), ("dyn-field", "Dynamic dispatch in struct field (`Box<dyn T>`, `Arc<dyn T>`)", "dispatch", True),
    ("clone-in-loop", "clone() called inside loop body (Arc/Rc suppressed when type is visible)", "performance", True), ("default-hasher", "HashMap/HashSet with default SipHash hasher", "performance", True),
    ("mixed-concerns", "Disconnected type groups indicate mixed concerns", "structure", True), ("inline-tests", "Test module embedded in source file", "structure", True), ("generic-naming", "High ratio of generic variable names in a function", "naming", True), ("let-underscore-result", "let _ = discards a potentially fallible Result", "structure", True),
    ("high-param-count", "Function has too many parameters", "structure", True), ("long-function-body", "Function body exceeds the configured line ceiling", "structure", False), ("module-root-definitions", "Item defined in a module-root file (mod.rs/lib.rs)", "structure", False), ("item-visibility-policy", "Configured item does not match its required visibility", "structure", False),
    ("feature-boundary", "Cargo feature crosses a configured boundary", "structure", False), ("flat-module-family", "Prefixed module family member outside its package directory", "structure", False), ("conflicting-module-root", "Sibling `<stem>.rs` and `<stem>/` module roots", "structure", False), ("ungated-test-api", "Test-only API under src/ not gated behind a feature", "structure", False),
    ("high-method-count", "Type has too many inherent methods (god-object)", "structure", False), ("scattered-inherent-impl", "A type's inherent impls span more than one file", "structure", False), ("large-source-file", "Source file exceeds the configured line ceiling", "structure", False),
]

# Module segments that are sinks, methods that change a vector or string, and types that are copied.
SINK_MODULES = {"net": "network", "process": "process_exec"}
VEC_MUTATIONS = [
    "push", "pop", "insert", "remove", "swap_remove", "truncate", "clear", "retain", "reserve", "resize", "extend", "append", "splice", "drain", "dedup", "dedup_by", "dedup_by_key",
    "sort", "sort_by", "sort_by_key", "sort_unstable", "sort_unstable_by", "sort_unstable_by_key", "reverse", "rotate_left", "rotate_right", "fill", "fill_with",
]
STRING_MUTATIONS = ["push_str", "insert_str", "replace_range"]
COPY_TYPES = ["bool", "char", "f32", "f64", "i8", "i16", "i32", "i64", "i128", "isize", "u8", "u16", "u32", "u64", "u128", "usize"]
