"""Control of execution and diagnostics."""
