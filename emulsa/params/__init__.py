"""Parameters: catalogue, validation, scaling, neutrality."""
