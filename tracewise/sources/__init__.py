"""Reading traces and power samples, finding runs, writing results."""
