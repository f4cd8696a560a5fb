"""Driver-side plans that issue distributed passes: optimising, fitting, diagnosing."""
