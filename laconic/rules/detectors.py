"""Command detectors: what a command line and its output look like."""

from __future__ import annotations

# Fixed values: (type, category, command patterns, content patterns); on equal confidence the earlier one wins.
DETECTORS: list[tuple[str, str, list[str], list[str]]] = [
    ("file-list", "shell", [r"(?i)^(?:fd\b|find\b|rg\s+--files\b)"], [r"(?m)^(?:\.{0,2}/|/|[\w.-]+/).+\.(?:rs|ts|tsx|js|jsx|py|go|java|rb|md|json|ya?ml|toml|txt|c|cc|cpp|h|hpp)$"]),
    ("structured-read", "shell", [r"(?i)^(?:jq\b|yq\b|cat\s+.*\.(?:json|ya?ml|toml)\b)"], []),
    ("file-read", "shell", [r"(?i)^(?:cat|bat|sed\s+-n|nl|head|tail)\b"], []),
    ("binary-read", "reverse", [r"(?i)^(?:otool|nm|strings|dwarfdump|lipo|vtool|atos|dyld_info|size)\b"], []),
    ("macos-inspect", "reverse", [r"(?i)^(?:sysctl|sw_vers|kmutil|codesign|plutil|spctl|memory_pressure|vm_stat|ioreg|system_profiler|lldb|kextstat)\b"], []),
    ("git-status", "git", [r"(?i)^git\s+status\b"], [r"(?m)^On branch ", r"(?m)^Changes (?:not staged|to be committed)", r"(?m)^Untracked files:"]),
    ("git-branch", "git", [r"(?i)^git\s+(?:branch|checkout|switch)\b"], [r"(?m)^\*\s+\S+$", r"(?i)Switched to (?:a new )?branch", '(?i)Already on [\'"][^\'"]+[\'"]']),
    ("git-diff", "git", [r"(?i)^git\s+(?:diff|show)\b"], [r"(?m)^diff --git ", r"(?m)^@@\s+-\d+,\d+\s+\+\d+,\d+\s+@@"]),
    ("git-log", "git", [r"(?i)^git\s+log\b"], [r"(?m)^commit [0-9a-f]{7,40}", r"(?m)^Author: "]),
    ("make", "build", [r"(?i)^make\b"], [r"(?m)make\[\d+\]: (?:Entering|Leaving) directory", r"make: \*\*\* "]),
    ("terraform-plan", "infra", [r"(?i)^terraform\s+plan\b"], [r"Terraform will perform the following actions:", r"(?i)Plan: \d+ to add"]),
    ("tofu-plan", "infra", [r"(?i)^(?:tofu|opentofu)\s+plan\b"], [r"OpenTofu will perform the following actions:", r"(?i)Plan: \d+ to add"]),
    ("systemctl-status", "infra", [r"(?i)^systemctl\s+status\b"], [r"(?m)^\s*Loaded:\s+", r"(?m)^\s*Active:\s+", r"(?m)^●\s+\S+\.service"]),
    ("test-vitest", "test", [r"(?i)^vitest\b", r"(?i)^npm\s+(?:run\s+)?test:vitest\b"], [r"(?i)\bvitest\b", r"(?m)^ ✓ ", r"(?m)^ ❯ ", r"(?i)Test Files\s+\d+\s+(?:passed|failed)"]),
    ("test-jest", "test", [r"(?i)^jest\b", r"(?i)^npm\s+(?:run\s+)?test\b"], [r"(?i)Test Suites:\s+\d+", r"(?i)Tests:\s+\d+", r"(?m)^PASS\s+", r"(?m)^FAIL\s+"]),
    ("npm-script-build", "build", [r"(?i)^npm\s+run\s+build\b", r"(?i)^npm\s+run\s+lint\b", r"(?i)^npm\s+run\s+typecheck\b"], [r"(?i)compiled (?:successfully|with \d+ errors?)", r"(?i)vite v[\d.]+", r"(?i)Checking formatting\.\.\.", r"TS\d{4}:"]),
    ("conda", "package", [r"(?i)^conda\b", r"(?i)^mamba\b"], [r"Collecting package metadata", r"Solving environment", r"Preparing transaction", r"Executing transaction", r"PackagesNotFoundError", r"UnsatisfiableError"]),
    ("xcodebuild", "build", [r"(?i)^xcodebuild\b"], [r"\*\* BUILD FAILED \*\*", r"\*\* BUILD SUCCEEDED \*\*", r"(?m)^error: ", r"(?m)^Testing failed:"]),
    ("cmake", "build", [r"(?i)^cmake\b"], [r"(?m)^-- The [A-Z]+ compiler identification is", r"(?m)^CMake Error", r"(?m)^-- Build files have been written to:"]),
    ("swiftc", "build", [r"(?i)^swiftc\b"], [r"(?m)^error: ", r"(?m)^warning: ", r"link command failed with exit code", r"clang: error: linker command failed"]),
    ("cargo-build", "build", [r"(?i)^cargo\s+(?:build|check|clippy|run)\b"], [r"(?m)^\s*Compiling ", r"(?m)^\s*Finished ", r"error\[E\d+\]", r"(?m)^error(?:\[|:)", r"(?m)^warning: "]),
    ("swift-build", "build", [r"(?i)^swift\s+(?:build|run|test)\b"], [r"(?m)^Compiling ", r"Build complete!", r"(?m)^error: ", r"Compiling for"]),
    ("go-build", "build", [r"(?i)^go\s+(?:build|run|vet|install)\b"], [r"(?m)^#\s+\S", r"(?m)\.go:\d+:\d+: "]),
    ("clang-build", "build", [r"(?i)^(?:clang|clang\+\+|gcc|g\+\+)\b"], [r"(?m)^.+:\d+:\d+: (?:error|warning|note): ", r"linker command failed", r"ld: "]),
    ("xcrun", "build", [r"(?i)^xcrun\b"], [r"coremlcompiler: error:", r"(?m)^== Devices ==", r"App installed:", r"(?m)^error: "]),
    ("test-pytest", "test", [r"(?i)^pytest\b", r"(?i)^python\s+-m\s+pytest\b"], [r"(?i)=+\s+(?:\d+\s+)?(?:passed|failed|errors?)", r"(?m)^E\s+", r"(?m)^FAILED "]),
    ("test-cargo", "test", [r"(?i)^cargo\s+(?:test|nextest)\b"], [r"(?m)^running \d+ tests?", r"(?m)^test\s+[\w:.-]+\s+\.\.\.\s+(?:ok|FAILED|ignored)", r"(?i)test result:\s+(?:ok|FAILED)"]),
    ("test-go", "test", [r"(?i)^go\s+test\b"], [r"(?m)^(?:ok|FAIL)\s+[\w./-]+\s+[\d.]+s", r"(?m)^--- FAIL: ", r"(?m)^panic: "]),
    ("build-typescript", "build", [r"(?i)^tsc\b", r"(?i)^npm\s+run\s+typecheck\b"], [r"TS\d{4}:", r"(?i)error TS\d{4}"]),
    ("build-eslint", "build", [r"(?i)^eslint\b", r"(?i)^npm\s+run\s+lint\b"], [r"\s+\d+:\d+\s+(?:error|warning)\s+", r"✖\s+\d+\s+problems?"]),
    ("build-webpack", "build", [r"(?i)^webpack\b", r"(?i)^npx\s+webpack\b", r"(?i)^npm\s+run\s+build:webpack\b"], [r"webpack\s+\d", r"(?i)compiled (?:successfully|with \d+ errors?)", r"(?i)asset .+\.js"]),
    ("build-vite", "build", [r"(?i)^vite\s+build\b", r"(?i)^npm\s+run\s+build\b", r"(?i)^pnpm\s+build\b"], [r"(?i)vite v[\d.]+", r"(?i)✓ built in", r"(?i)transforming \(\d+\)"]),
    ("biome", "build", [r"(?i)^biome\b", r"(?i)^npx\s+biome\b"], [r"lint/[A-Za-z0-9/.-]+", r"(?i)Checked \d+ files? in"]),
    ("prettier", "build", [r"(?i)^prettier\b", r"(?i)^npx\s+prettier\b"], [r"(?m)^Checking formatting\.\.\.", r"(?i)Code style issues found"]),
    ("turbo", "build", [r"(?i)^turbo\b", r"(?i)^npx\s+turbo\b"], [r"(?m)^• Packages in scope:", r"(?m)^Tasks:\s+\d+\s+successful"]),
    ("nx", "build", [r"(?i)^nx\b", r"(?i)^npx\s+nx\b"], [r"(?m)^NX\s+", r"(?m)^> nx run "]),
    ("playwright", "test", [r"(?i)^playwright\s+test\b", r"(?i)^npx\s+playwright\s+test\b"], [r"(?i)Running \d+ tests? using \d+ workers?", r"(?m)^\s+\d+ failed"]),
    ("npm-install", "package", [r"(?i)^(?:npm|pnpm|yarn)\s+(?:install|add|update)\b"], [r"(?i)added \d+ packages", r"(?i)packages are looking for funding", r"(?i)audited \d+ packages"]),
    ("npm-audit", "package", [r"(?i)^(?:npm|pnpm|yarn)\s+audit\b"], [r"(?i)found \d+ vulnerabilities", r"(?i)\b(?:low|moderate|high|critical)\b"]),
    ("ruff", "build", [r"(?i)^ruff\b", r"(?i)^uv\s+run\s+ruff\b"], [r"(?m)^[\w./-]+\.py:\d+:\d+:\s+[A-Z]\d+", r"(?i)Found \d+ errors?\."]),
    ("mypy", "build", [r"(?i)^mypy\b", r"(?i)^python\s+-m\s+mypy\b"], [r"(?m)^[\w./-]+\.py:\d+:\s+error:", r"(?i)Found \d+ errors? in \d+ files?"]),
    ("pip", "package", [r"(?i)^pip\s+(?:install|download|uninstall)\b", r"(?i)^python\s+-m\s+pip\b"], [r"(?m)^Collecting ", r"(?m)^Successfully installed "]),
    ("python-script", "build", [r"(?i)^python(?:\d+(?:\.\d+)?)?\s", r"(?i)^python(?:\d+(?:\.\d+)?)?$"], [r"Traceback \(most recent call last\):", r'(?m)^File ".+", line \d+', r"AssertionError", r"ModuleNotFoundError", r"ImportError"]),
    ("uv-sync", "package", [r"(?i)^uv\s+sync\b", r"(?i)^uv\s+pip\s+install\b"], [r"(?m)^Resolved \d+ packages?", r"(?m)^Installed \d+ packages?"]),
    ("poetry-install", "package", [r"(?i)^poetry\s+install\b"], [r"(?m)^Installing dependencies from lock file", r"(?m)^Package operations:"]),
    ("golangci-lint", "build", [r"(?i)^golangci-lint\b"], [r"(?m)^[\w./-]+\.go:\d+:\d+:", r"(?m)^\d+ issues?:"]),
    ("bundle-install", "package", [r"(?i)^bundle\s+install\b"], [r"(?m)^Fetching gem metadata from ", r"(?m)^Bundle complete!"]),
    ("rubocop", "build", [r"(?i)^rubocop\b", r"(?i)^bundle\s+exec\s+rubocop\b"], [r"(?m)^Inspecting \d+ files", r"(?m)^[\w./-]+\.rb:\d+:\d+:\s+[A-Z]:"]),
    ("docker-ps", "docker", [r"(?i)^docker\s+ps\b"], [r"(?m)^CONTAINER ID\s+IMAGE\s+COMMAND"]),
    ("docker-logs", "docker", [r"(?i)^docker\s+(?:compose\s+)?logs\b"], [r"(?m)^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", r"(?m)^Attaching to "]),
    ("docker-build", "docker", [r"(?i)^docker\s+(?:build|buildx\s+build)\b", r"(?i)^(?:docker\s+compose|docker-compose)\s+build\b"], [r"Successfully built \w+", r"exit code: \d+"]),
    ("aws", "cloud", [r"(?i)^aws\b"], [r"An error occurred \([A-Za-z0-9]+\) when calling", r"(?m)^(?:upload|download): "]),
    ("gcloud", "cloud", [r"(?i)^gcloud\b"], [r"(?m)^ERROR: \(gcloud\.", r"(?m)^Updated property \["]),
    ("ssh", "cloud", [r"(?i)^ssh\b"], [r"Permission denied \(", r"Host key verification failed", r"Connection timed out"]),
    ("rsync", "cloud", [r"(?i)^rsync\b"], [r"(?m)^sending incremental file list", r"(?m)^rsync error:"]),
    ("curl", "cloud", [r"(?i)^curl\b"], [r"curl: \(\d+\)", r"(?m)^HTTP/\d(?:\.\d)? \d{3}"]),
    ("wget", "cloud", [r"(?i)^wget\b"], [r"(?m)^--\d{4}-\d{2}-\d{2}", r"(?m)^ERROR \d{3}:"]),
    ("json-output", "generic", [r"(?i)^jq\b", r"(?i)^cat\s+.*\.json\b"], [r"^\s*[\[{][\s\S]*[\]}]\s*$"]),
    ("shell-ls", "shell", [r"(?i)^ls(?:\s+-[A-Za-z]+)?\b"], [r"(?m)^total \d+", r"(?m)^\S+\s+\S+\s+\d+\s+\w+\s+\d{1,2}\s+"]),
    ("shell-find", "shell", [r"(?i)^find\b"], [r"(?m)^(?:\.{1,2}|/|[\w.-]+/).+"]),
    ("shell-grep", "shell", [r"(?i)^(?:grep|rg|ag)\b"], [r"(?m)^[\w./-]+\.(?:ts|tsx|js|jsx|py|go|rs|java|rb|md|json|ya?ml|txt):\d*:", r"(?m)^[\w./-]+/[\w./-]+:\d*:"]),
    ("shell-ps", "shell", [r"(?i)^ps\b"], [r"(?m)^(?:USER\s+PID|\s*PID\s+)"]),
    ("shell-df", "shell", [r"(?i)^df\b"], [r"(?m)^Filesystem\s+.*Use%"]),
    ("shell-du", "shell", [r"(?i)^du\b"], [r"(?m)^\d+(?:\.\d+)?[KMGTP]?\s+\S+"]),
    ("error-stacktrace", "generic", [], [r"Traceback \(most recent call last\):", r"(?m)^\s+at\s+\S+\s+\(.+:\d+:\d+\)", r"(?m)^panic: ", r"(?m)^thread '[^']+' panicked at"]),
    ("generic-error", "generic", [], [r"Error:", r"Exception:", r"Traceback \(most recent call last\):"]),
]

# First words of known commands, as patterns.
PREFIXES = [
    "git", "make", "terraform", "tofu", "opentofu", "systemctl", "npm", "pnpm", "yarn", "vitest", "jest", "pytest",
    "python", "go", "cargo", "tsc", "eslint", "webpack", "vite", "biome", "prettier", "turbo", "nx", "playwright",
    "ruff", "mypy", "pip", "uv", "poetry", "golangci-lint", "bundle", "rubocop", "kubectl", "composer", "gh", "docker",
    "aws", "gcloud", "ssh", "rsync", "curl", "wget", "ls", "find", "fd", "grep", "rg", "ag",
    "cat", "bat", "sed", "nl", "head", "tail", "jq", "yq", "ps", "df", "du", "otool",
    "nm", "strings", "dwarfdump", "lipo", "vtool", "atos", "swift", "clang", "gcc", "g++", "clang++", "sysctl",
    "sw_vers", "kmutil", "codesign", "plutil", "spctl", "memory_pressure", "vm_stat", "ioreg", "system_profiler", "dyld_info", "lldb", "kextstat",
]

# Which grouping each type gets (any other type: files), and the types whose lines are never folded.
GROUP_FILES = ["git-status", "shell-ls"]
GROUP_TESTS = ["test-vitest", "test-jest", "test-pytest", "test-cargo", "test-go", "playwright"]
GROUP_BUILDS = ["build-typescript", "build-eslint", "build-webpack", "build-vite", "biome", "ruff", "mypy", "golangci-lint", "rubocop"]
GROUP_NEVER = ["file-read", "structured-read", "file-list", "shell-grep", "shell-find", "json-output", "python-script", "binary-read", "macos-inspect", "cargo-build", "swift-build", "go-build", "clang-build"]
KEEP_LINES = ["file-read", "binary-read", "structured-read", "macos-inspect", "json-output"]
