"""Where series come from: role bindings, extraction, axis completion, targets."""
