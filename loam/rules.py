"""Default rule tables. Every function that uses one takes another in its place.

The values below are fixed: results only agree with data labelled before if they stay as they are.
"""

# Categories, spellings that map to them, and the order that breaks ties.
CATEGORIES = ["bluetooth", "wifi", "disk", "battery", "performance", "permissions", "system", "diagnostics", "general"]
CATEGORY_ALIASES = {
    "network": "wifi", "networking": "wifi", "wi-fi": "wifi", "wireless": "wifi", "ethernet": "wifi",
    "security": "permissions", "privacy": "permissions", "preferences": "system", "prefs": "system", "config": "system",
    "spotlight": "diagnostics", "logs": "diagnostics", "logging": "diagnostics", "processes": "performance", "process": "performance",
    "cpu": "performance", "memory": "performance", "storage": "disk", "power": "battery",
}
CATEGORY_PRIORITY = ["bluetooth", "battery", "disk", "wifi", "diagnostics", "permissions", "performance", "system"]
CATEGORY_KEYWORDS = {
    "bluetooth": ["bluetooth", "airpods", "airpod", "magic mouse", "magic keyboard", "magic trackpad", "headphone", "headphones", "handsfree", "a2dp", "hci"],
    "wifi": ["wi-fi", "wifi", "wireless", "airport", "802.11", "ssid", "hotspot", "ethernet", "vpn", "dns", "dhcp", "router", "network", "networking", "bonjour", "captive portal"],
    "disk": ["apfs", "hfs+", "filesystem", "file system", "disk utility", "diskutil", "time machine", "fusion drive", "hard drive", "hard disk", "partition", "unmount", "external drive", "fsck", "volume", "ntfs", "exfat", "format disk"],
    "battery": ["battery", "charging", "charger", "magsafe", "power adapter", "energy saver", "hibernate", "hibernatemode", "pmset", "wake from sleep", "sleep wake", "standby", "amperage", "cycle count"],
    "performance": ["beachball", "spinning wheel", "kernel_task", "high cpu", "cpu usage", "memory pressure", "swap", "sluggish", "freezing", "activity monitor", "overheating", "fans spinning", "slow performance", "running slow"],
    "permissions": ["tccutil", "tcc", "privacy settings", "gatekeeper", "codesign", "code signing", "notariz", "quarantine", "keychain", "sandbox", "csrutil", "full disk access", "accessibility access", "chmod", "chown", "permission denied", "operation not permitted"],
    "diagnostics": ["kernel panic", "crash report", "crashreport", "log show", "console.app", "diagnosticreports", "spindump", "sysdiagnose", "stack trace", "backtrace", "syslog", "panic log"],
    "system": ["launchd", "launchctl", "launchagent", "launchdaemon", "plist", "defaults write", "nvram", "recovery mode", "safe mode", "spotlight", "mdfind", "finder", "system preferences", "system settings", "homebrew", "boot", "startup", "login items"],
}

# Versions: name, number pattern, canonical value; newest first.
VERSION_PATTERNS = [
    (r"\bsequoia\b|\bmac\s?os\s*15(?:\.\d+)?\b", "15"), (r"\bsonoma\b|\bmac\s?os\s*14(?:\.\d+)?\b", "14"), (r"\bventura\b|\bmac\s?os\s*13(?:\.\d+)?\b", "13"),
    (r"\bmonterey\b|\bmac\s?os\s*12(?:\.\d+)?\b", "12"), (r"\bbig\s*sur\b|\bmac\s?os\s*11(?:\.\d+)?\b", "11"), (r"\bcatalina\b|\b10\.15(?:\.\d+)?\b", "10.15"),
    (r"\bmojave\b|\b10\.14(?:\.\d+)?\b", "10.14"), (r"\bhigh\s*sierra\b|\b10\.13(?:\.\d+)?\b", "10.13"), (r"\bsierra\b|\b10\.12(?:\.\d+)?\b", "10.12"),
    (r"\bel\s*capitan\b|\b10\.11(?:\.\d+)?\b", "10.11"), (r"\byosemite\b|\b10\.10(?:\.\d+)?\b", "10.10"),
]
#: What a match of each of these patterns has for certain.
VERSION_SIGNS = {
    "15": ["sequoia", "15"], "14": ["sonoma", "14"], "13": ["ventura", "13"], "12": ["monterey", "12"], "11": ["sur", "11"], "10.15": ["catalina", "10.15"],
    "10.14": ["mojave", "10.14"], "10.13": ["sierra", "10.13"], "10.12": ["sierra", "10.12"], "10.11": ["capitan", "10.11"], "10.10": ["yosemite", "10.10"],
}
VERSION_NAMES = {"sequoia": "15", "sonoma": "14", "ventura": "13", "monterey": "12", "bigsur": "11", "catalina": "10.15", "mojave": "10.14", "highsierra": "10.13"}
INTAKE_VERSION_NAMES = {"tahoe": "26", "sequoia": "15", "sonoma": "14", "ventura": "13", "monterey": "12", "big sur": "11", "catalina": "10.15"}
INTAKE_VERSION_NUMBER = r"\b(?:macos|os x|osx|version)\s*(1[0-5]|2[0-6])(?:\.\d+){0,2}\b"
INTAKE_CATEGORIES = {
    "wifi": ["wifi", "wi-fi", "wireless", "network drops"], "bluetooth": ["bluetooth", "airpods", "magic mouse", "magic keyboard"],
    "battery": ["battery", "won't sleep", "wont sleep", "drain", "power"], "disk": ["disk", "storage", "ssd", "drive", "apfs", "mount"],
    "performance": ["slow", "lag", "beachball", "spinning", "cpu", "memory pressure"], "permissions": ["permission", "tcc", "privacy", "screen recording", "microphone", "camera access"],
}
PAGE_CATEGORIES = {
    "bluetooth": ["bluetooth", "airpods"], "wifi": ["wi-fi", "wifi", "wireless", "network", "ethernet", "hotspot"], "battery": ["battery", "charge", "charging", "power adapter", "low power"],
    "disk": ["disk", "storage", "startup disk", "apfs", "volume", "format", "disk utility"], "performance": ["slow", "performance", "memory pressure", "beach ball", "unresponsive", "high cpu"],
    "permissions": ["permission", "privacy", "gatekeeper", "full disk access", "accessibility access"], "diagnostics": ["console", "log show", "diagnostic", "crash report", "sysdiagnose"],
    "system": ["macos", "system settings", "update", "reset", "restart", "preference"],
}

# Difficulty: signals of tier 3 and of tier 2; else tier 1. "/Library/" never matches lower-cased text; it is kept as it is.
TIER_3 = ["log show --predicate", "kernel extension", "kext", "recovery mode", "internet recovery", "smc reset", "system integrity protection", "csrutil", "codesign --verify", "entitlements", "/dev/", "iokit", "dtrace", "dtruss", "kernel panic", "kernel debug"]
TIER_2 = ["terminal", "sudo ", "command line", "defaults write", "defaults delete", "tccutil", "launchctl", "nvram ", "diskutil ", "pmset ", "chmod ", "chown ", "/etc/", "/var/", "/usr/", "/Library/", "system preferences", "log show"]

# Personal data, in the order of replacement: kind, pattern, replacement.
PII_RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    ("mac_address", r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b", "[MAC]"),
    ("ipv6", r"\b(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}\b|\b[0-9A-Fa-f]{0,4}::(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4}\b", "[IPV6]"),
    ("ipv4", r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b", "[IPV4]"),
    ("serial_number", r"(?i)(serial\s*(?:number|no\.?|#)?\s*[:=]?\s+)([A-Z0-9]{8,17})\b", "$1[SERIAL]"),
    ("user_path", r"(/Users/)(?!Shared\b)([A-Za-z0-9._-]+)", "$1[USER]"),
]
# Abusive requests, first match wins.
ABUSE_RULES = [
    ("repeat_flood", r"(?i)\b(?:repeat|say|print|write|type|output)\b.{0,50}\b\d{3,}(?:,\d{3})*\s*times\b"),
    ("repeat_forever", r"(?i)\b(?:repeat|say|print|write|output|loop)\b.{0,50}\b(?:forever|endlessly|infinitely|non[- ]?stop|in an? (?:infinite|endless) loop)\b"),
    ("bulk_prose", r"(?i)\bwrite\b.{0,40}\b(?:essay|story|poem|song|novel|screenplay|blog ?post|article)\b"),
    ("web_generation", r"(?i)\b(?:generate|create|build|write|make)\b.{0,50}\b(?:html|css|web ?site|web ?page|landing page|react app)\b"),
    ("injection", r"(?i)\b(?:ignore|disregard|forget)\b.{0,30}\b(?:previous|prior|above|all|your|earlier)\b.{0,30}\b(?:instructions?|rules?|prompts?|system)\b"),
]
# Provider errors: kind, parts of the message, parts of the type name; first match wins.
ERROR_RULES = [
    ("quota_exhausted", ["insufficient_quota", "quota", "billing", "credit", "payment required"], []),
    ("rate_limit", ["rate limit", "rate_limit", "429"], ["ratelimit"]),
    ("timeout", ["timed out", "timeout"], ["timeout"]),
    ("auth", ["api key", "api_key", "401", "403", "permission"], ["auth"]),
]

# Signals in messages.
TRIED_SIGNALS = ["already tried", "doesn't work", "still not", "tried restarting", "tried turning off", "rebooted", "reinstalled", "still happening", "still broken", "even after restart", "toggled", "reset smc", "reset nvram", "log show", "terminal", "checked the logs", "sudo"]
FAILURE_SIGNALS = ["didn't work", "didnt work", "did not work", "still", "no luck", "same issue", "same problem", "same thing", "what else", "tried that", "that failed", "not working", "no change", "nothing changed", "already did"]
TOOL_SIGNALS = ["terminal", "sudo", "defaults", "tccutil", "nvram", "diskutil", "log show", "plist", "kext", "recovery"]
IMPLIED_TRIED = [
    (["log show", "console.app", "system.log", "/var/log", "diagnosticreports", ".panic", "log stream", "read the log", "checked the log", "in the logs"], "read system logs in Terminal/Console (past the GUI checks)"),
    (["sudo ", "in terminal", "ran the command", "command line", "tccutil", "defaults write", "diskutil", "pmset", "launchctl", "killall"], "ran Terminal commands (past basic Settings toggles)"),
    (["reinstalled", "clean install", "reset nvram", "reset smc", "safe mode", "recovery mode", "reset the smc", "reset the nvram"], "did advanced resets/reinstall (past restart and toggles)"),
    (["plist", "preference file", "library/preferences", "preferences.plist"], "edited preference plists (past the Settings UI)"),
]
TOPIC_SIGNALS = ["mac", "macos", "os x", "osx", "imac", "macbook", "wifi", "wi-fi", "bluetooth", "airpods", "disk", "storage", "ssd", "apfs", "battery", "kernel", "panic", "spotlight", "finder", "safari", "icloud", "keychain", "permission", "tcc", "privacy", "terminal", "sudo", "nvram", "smc", "diskutil", "launchctl", "defaults", "plist", "crash", "freeze", "beachball", "sonoma", "sequoia", "ventura", "monterey", "catalina", "tahoe", "m1", "m2", "m3", "m4", "apple silicon", "intel chip", "system settings", "system preferences", "menu bar", "dock", "airdrop", "time machine"]
RECENCY_SIGNALS = ["latest", "newest", "just updated", "just installed", "after updating", "beta", "release candidate", "this version", "current version", "sequoia", "15.", "26."]
SALIENT_LINE = r"(?i)error|fail|panic|denied|deny|timeout|timed out|crash|warn|refus|invalid|unable|missing|drop|disconnect|assert|prevent|blocked|corrupt|exceed|dfs|rssi"
RESOLUTION_PHRASES = ["this fixed it", "fixed by", "worked for me", "solved by", "this works", "resolved by", "turns out", "the solution is", "closing this because", "closing as", "fix is to", "switching to", "downgrading to", "upgrading to"]

# Commands whose manual pages settle exact syntax, and tools that mark a line of an answer as a command.
MANUAL_COMMANDS = ["log", "pmset", "tccutil", "defaults", "launchctl", "diskutil", "dscl", "spctl", "xattr", "codesign", "kmutil", "csrutil", "nvram", "mdutil", "mdfind", "scutil", "networksetup", "systemsetup", "ioreg", "system_profiler", "fsck", "hdiutil", "plutil", "bputil", "profiles", "softwareupdate", "wdutil", "syslog", "powermetrics", "kextstat", "sysctl", "dscacheutil", "dsconfigad", "tmutil"]
TOOLS = ["sudo", "defaults", "tccutil", "diskutil", "pmset", "launchctl", "log", "xattr", "spctl", "killall", "nvram", "csrutil", "mdutil", "scutil", "networksetup", "systemsetup", "kextstat", "kmutil", "bless", "fsck", "dscl", "profiles", "softwareupdate", "plutil", "codesign", "wdutil", "system_profiler", "ioreg", "powermetrics", "tmutil", "mdfind", "hdiutil", "dscacheutil", "sysctl", "airport", "syslog", "osascript", "caffeinate"]
COMMAND_STOP_WORDS = ["the", "a", "an", "to", "of", "and", "or", "in", "on", "for", "with", "your", "you", "run", "then", "this", "that", "it", "is", "sudo"]

# Retrieval, accounting, evaluation.
SOURCE_WEIGHTS = {"apple_support": 1.05, "apple_technotes": 1.04, "macos_man_pages": 1.04, "apple_developer_docs": 1.03, "apple_developer_forums": 1.02, "ask_different": 1.00, "stackoverflow": 1.00, "wwdc_transcripts": 0.99, "github_issues": 0.98, "reddit": 0.97}
PRICES = [("llama-3.3-70b", 0.59, 0.79), ("llama-3.1-8b", 0.05, 0.08), ("gpt-4o-mini", 0.15, 0.60)]
DEFAULT_PRICE = (0.59, 0.79)
COST_BUCKETS = [0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1]
LATENCY_BUCKETS = [0.5, 1, 2, 4, 8, 15, 30, 60]
QA_TAGS = ["macos", "osx", "mac-osx", "mac"]
SKIPPED_FLAIRS = ["news", "rumor", "humor", "meme", "meta", "announcement", "weekly"]
ID_PREFIXES = [("TN2", "apple_technotes"), ("TN3_", "apple_technotes"), ("DEVDOC_", "apple_developer_docs"), ("DEVFORUM_", "apple_developer_forums"), ("SO_", "stackoverflow"), ("REDDIT_", "reddit"), ("GH_", "github_issues"), ("WWDC_", "wwdc_transcripts")]
ID_WORDS = ("MANPAGE", ["LOG", "DEFAULTS", "TCCUTIL", "PMSET"], "macos_man_pages", "apple_support")

# Sessions: words that make one relevant, and the version that a year stands for.
SESSION_WORDS = ["macos", " mac ", "privacy", "security", "permissions", "network", "bluetooth", "disk", "apfs", "battery", "power", "performance", "memory", "diagnostic", "crash", " log", "launchd", "daemon", "sandbox", "gatekeeper", "notariz", "signing", "certificate", "keychain", "tcc", "system extension", "kernel extension", "endpoint security", "filesystem", "xpc", "app lifecycle", "background task", "spotlight", "metadata", "nsuserdefaults", "preferences", "oslog", "core bluetooth", "network framework"]
YEAR_VERSIONS = {2019: "10.15", 2020: "11", 2021: "12", 2022: "13", 2023: "14", 2024: "15"}
# Parts of addresses that are not crawled.
BLOCKED_URLS = ["/kb/index?", "src=support_app", "/docs/product/", "MANUALS/", "/guide/"]
REACTIONS = ["+1", "laugh", "hooray", "heart", "rocket", "eyes"]
