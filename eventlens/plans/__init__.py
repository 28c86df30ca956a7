"""Multi-step plans built from the operators (cleaning, feature
engineering, training sweeps, inference, explanation) and the catalogue of
registered queries with their SQL oracles."""
