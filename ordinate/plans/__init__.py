"""Plans made of several operators: gradients, training, schedules, adapters, sampling."""
