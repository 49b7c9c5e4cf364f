"""Live progress over lifecycle events: streaming jobs and their batch twins."""
