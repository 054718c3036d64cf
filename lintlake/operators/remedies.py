"""What to do about a finding, by rule."""

REMEDIES = {
    "architecture.large-module": "Split the module along its responsibilities.",
    "architecture.module-fan-out": "Group related modules under fewer parents.",
    "architecture.public-api-surface": "Make public only what callers need.",
    "ci.github-event-shell-interpolation": "Pass event data through an environment variable and quote it in the script.",
    "complexity.cognitive": "Take branches out into named functions and return early.",
    "complexity.cyclomatic": "Split the function at its decisions.",
    "complexity.nesting-depth": "Return early or take inner blocks out.",
    "concurrency.blocking-call-in-async": "Use the async form of the call, or run it on a thread for blocking work.",
    "concurrency.lock-across-await": "Drop the guard before the await, or use an async lock.",
    "concurrency.unbounded-channel": "Give the channel a bound so that slow receivers hold senders back.",
    "dead-code.unused-private-function": "Remove the function or use it.",
    "dead-code.unused-private-item-candidate": "Remove the item, or check what refers to it by other means.",
    "dependency.duplicate-locked-version": "Align the requirements so that one version is locked.",
    "dependency.git-source": "Depend on a published version.",
    "dependency.git-unpinned-revision": "Pin the source to a revision.",
    "dependency.missing-package-metadata": "Add the description and license to the manifest.",
    "dependency.path-source": "Depend on a published version outside the workspace.",
    "dependency.wildcard-version": "Require a range of known versions.",
    "design.god-function": "Give each step of the function a function of its own.",
    "docs.commented-out-code": "Delete the code; history keeps it.",
    "docs.missing-errors-section": "Describe under `# Errors` when each error comes up.",
    "docs.missing-panics-section": "Describe under `# Panics` when the function panics.",
    "docs.missing-param-doc": "Say in the documentation what each parameter means.",
    "docs.missing-public-doc": "Say in one line what the item is for.",
    "docs.missing-readme": "Add a README to the project's root.",
    "docs.missing-return-doc": "Say in the documentation what is returned.",
    "docs.missing-safety-section": "List under `# Safety` what callers must uphold.",
    "docs.stale-todo": "Add an owner, an issue or a reason, or do it.",
    "docs.weak-safety-rationale": "Name the invariant that makes the block sound.",
    "error-handling.production-panic": "Return an error, or name the invariant that rules the panic out.",
    "error-handling.public-unwrap": "Return a Result and let the caller decide.",
    "error-handling.unimplemented-placeholder": "Implement the function before it ships.",
    "metrics.halstead-volume": "Split dense logic into smaller functions.",
    "metrics.maintainability-pressure": "Cut length, branches or operators of the function.",
    "modernisation.manual-contains": "Call `contains`.",
    "modernisation.manual-is-empty": "Call `is_empty`.",
    "modernisation.manual-strip-prefix": "Call `strip_prefix`.",
    "modernisation.manual-unwrap-or-default": "Call `unwrap_or_default`.",
    "modernisation.public-field": "Offer methods where the field has invariants.",
    "modernisation.question-mark-candidate": "Use the `?` operator.",
    "naming.boolean-prefix": "Begin the name with a word such as is, has or can.",
    "naming.generic-function": "Name what the function does to what.",
    "naming.identifier-shadow": "Rename the binding.",
    "naming.placeholder-identifier": "Use a name of the domain.",
    "naming.short-variable": "Spell the name out, or list it among the accepted abbreviations.",
    "performance.clone-in-loop": "Borrow, or clone once before the loop.",
    "performance.format-in-loop": "Write into one buffer.",
    "performance.regex-in-loop": "Compile the pattern once before the loop.",
    "security.hardcoded-bind-all-interfaces": "Bind the address that is needed, or make it a setting.",
    "security.insecure-rng-for-secrets": "Use a generator made for secrets, such as the operating system's.",
    "security.path-traversal-candidate": "Reject `..` and absolute parts, or canonicalise and compare the start.",
    "security.process-command": "Pass fixed arguments, and no shell text made from input.",
    "security.sql-dynamic-query": "Bind parameters instead of building the text.",
    "security.tls-verification-disabled": "Leave verification on and trust the certificate explicitly.",
    "security.unsafe-block": "State above the block why it is sound.",
    "security.weak-crypto": "Use a current primitive.",
    "sensitive-data.api-key-pattern": "Revoke the key and load it from a secret store.",
    "sensitive-data.aws-access-key": "Revoke the key and load it from a secret store.",
    "sensitive-data.database-url-password": "Take the password from the environment.",
    "sensitive-data.hardcoded-env-value": "Take the value from the environment.",
    "sensitive-data.high-entropy-string": "Check whether the string is a secret, and move it if so.",
    "sensitive-data.jwt-token": "Revoke the token and keep it out of the source.",
    "sensitive-data.pii-test-fixture": "Use invented data from reserved ranges.",
    "sensitive-data.private-key": "Revoke the key and keep it out of the source.",
    "sensitive-data.url-embedded-credentials": "Take the credentials from the environment.",
    "size.file-length": "Split the file.",
    "size.function-length": "Take steps out into functions of their own.",
    "size.parameter-count": "Group parameters that belong together.",
    "test-quality.conditional-logic": "Write one test for each case.",
    "test-quality.ignored-without-reason": "Say why the test is ignored.",
    "test-quality.long-test": "Split the test, or move its setup out.",
    "test-quality.no-assertions": "Assert what the test is about.",
    "test-quality.should-panic-without-expected": "Name the expected message.",
    "test-quality.sleep-in-test": "Wait for the event itself.",
    "test-quality.trivial-assertion": "Assert something that can fail.",
    "test-quality.unwrap-in-test": "Use expect() with the intent of the setup.",
    "waste.unnecessary-clone-candidate": "Borrow where ownership isn't needed.",
    "waste.unreachable-code": "Remove the statement.",
    "waste.unwrap-expect": "Pass the error on, or say why it can't happen.",
}
